"""Mail and SMS: filters, classes, senders, states, raw messages."""

from __future__ import annotations

import email
import email.header
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import hits, strip

# What marks promotion in a subject or in the beginning of a body.
PROMO_PATTERNS = (
    r"\[광고\]", r"\[AD\]", r"\[EVENT\]", r"\[마케팅\]", r"\[프로모션\]", r"\[할인\]", r"\[SALE\]", r"\[ANNOUNCE\]", r"뉴스레터", r"newsletter", r"이벤트 안내", r"특가", r"한정.*할인",
    r"수신거부", r"unsubscribe", r"수신동의", r"opt.?out", r"쿠폰", r"coupon", r"혜택", r"event 안내", r"무료.*체험", r"free trial", r"체험판", r"업데이트 소식$", r"update$",
)
PROMO_BODY = ("수신거부", "unsubscribe", "수신을 원치 않으", "이 메일은 발신전용", "광고메일", "promotional email", "마케팅 메일")
PREVIEW = 500

# Words of advertising and of importance.
AD_WORDS = (
    "광고", "홍보", "프로모션", "세일", "할인", "특가", "advertising", "promotion", "sale", "discount", "뉴스레터", "newsletter", "구독", "subscribe",
    "이벤트", "event", "참여", "응모", "당첨", "무료", "free", "체험", "trial",
)
IMPORTANT_WORDS = ("긴급", "urgent", "중요", "important", "계약", "contract", "견적", "quotation", "주문", "order", "발송", "shipping", "송장", "invoice", "결제", "payment")


def is_promotional(subject: Column, body: Column, patterns: Sequence[str] = PROMO_PATTERNS, words: Sequence[str] = PROMO_BODY) -> Column:
    """Patterns see subject and preview as one text, so that those with $ look at the preview's end."""
    preview = F.substring(F.coalesce(body, F.lit("")), 1, PREVIEW)
    whole = F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), preview)
    return F.regexp_like(whole, F.lit("(?iu)(?d)(?:" + "|".join(patterns) + ")")) | (hits(F.lower(preview), [w.lower() for w in words]) > 0)


def classify(subject: Column, sender: Column, body: Column, ads: Sequence[str] = AD_WORDS, important: Sequence[str] = IMPORTANT_WORDS) -> Column:
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (subject, sender, body)]))
    return F.when(hits(whole, ads) >= 2, "ad").when(hits(whole, important) >= 1, "important").otherwise("normal")


def sender(raw: Column) -> Column:
    """Struct of the address, in lower case, and the display name or else what stands before the @."""
    inside = F.nullif(F.regexp_extract(raw, "<([^>]+)>", 1), F.lit(""))
    address = strip(F.lower(F.coalesce(inside, raw)))
    name = F.nullif(F.regexp_extract(raw, r"""^["']?(.+?)["']?\s*<""", 1), F.lit(""))
    shown = F.regexp_replace(F.regexp_replace(strip(name), '^"+|"+$', ""), "^'+|'+$", "")
    return F.struct(address.alias("address"), F.coalesce(shown, F.split_part(address, F.lit("@"), F.lit(1))).alias("name"))


def without_senders(mail: DataFrame, excluded: DataFrame) -> DataFrame:
    """mail (from, ...) but of excluded.address."""
    out = excluded.select(F.lower(strip(F.col("address"))).alias("address")).distinct()
    return mail.join(out, sender(mail["from"])["address"] == out["address"], "left_anti")


def states(mail: DataFrame, excluded: DataFrame, seen: DataFrame, responses: DataFrame) -> DataFrame:
    """folder, uid, status of mail (folder, uid, subject, from, body): sent, excluded, seen, missing, promo_skipped, llm_failed,
    no_actions or extracted, the first that fits. responses: uid_key, actionable; a row without actionable is a failed call."""
    key = F.concat_ws(":", F.coalesce("folder", F.lit("INBOX")), F.coalesce("uid", F.lit("")))
    m = mail.withColumns({"uid_key": key, "address": sender(F.col("from"))["address"]})
    m = m.join(excluded.select(F.lower(strip(F.col("address"))).alias("address")).distinct().withColumn("_out", F.lit(True)), "address", "left")
    m = m.join(seen.select("uid_key").distinct().withColumn("_seen", F.lit(True)), "uid_key", "left").join(responses.select("uid_key", "actionable"), "uid_key", "left")
    status = (
        F.when(F.col("folder") == "Sent Messages", "sent").when(F.col("_out"), "excluded").when(F.col("_seen"), "seen").when(F.col("body").isNull(), "missing")
        .when(is_promotional(F.col("subject"), F.col("body")), "promo_skipped").when(F.col("actionable").isNull(), "llm_failed").when(~F.col("actionable"), "no_actions").otherwise("extracted")
    )
    return m.select("folder", "uid", status.alias("status"))


def to_fetch(uids: DataFrame, processed: DataFrame, limit: int) -> DataFrame:
    """folder, uid: of each folder the newest new ones."""
    new = uids.join(processed.select("folder", "uid"), ["folder", "uid"], "left_anti")
    return new.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("uid")))).filter(F.col("place") <= limit)


def sms(payload: Column) -> Column:
    """Sender, message, thread of a VARIANT payload. A key that is there decides, even with null."""
    def first(*names: str) -> Column:
        out = F.lit("")
        for n in reversed(names):
            v = F.try_variant_get(payload, f"$.{n}", "variant")
            out = F.when(v.isNotNull(), F.try_variant_get(v, "$", "string")).otherwise(out)
        return out

    return F.struct(first("from", "sender").alias("sender"), first("body", "text", "message").alias("message"), first("thread_id").alias("thread_id"))


def sms_todos(messages: DataFrame, todos: DataFrame) -> DataFrame:
    """todos (id, ...) with what they come from: source, source_phone, sms_thread, sms_timestamp of messages (id, sender, thread_id, at).
    Which to-dos a message has is for an extraction stage to say."""
    m = messages.select("id", F.lit("sms").alias("source"), F.col("sender").alias("source_phone"), F.col("thread_id").alias("sms_thread"), F.col("at").alias("sms_timestamp"))
    return todos.drop(*[c for c in m.columns if c != "id"]).join(m, "id")


def excluded_after(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    clean = lambda df: df.select(F.lower(strip(F.col("address"))).alias("address"))
    return clean(current).unionByName(clean(added)).distinct().join(clean(removed), "address", "left_anti")


def _header(value: str | None, joiner: str, errors: str) -> str:
    parts = []
    for raw, charset in email.header.decode_header(value or ""):
        if isinstance(raw, bytes):
            try:
                raw = raw.decode(charset or "utf-8", errors)
            except LookupError:
                raw = raw.decode("utf-8", errors)
        parts.append(raw)
    return joiner.join(parts)


def _payload(part, charset: str | None, errors: str) -> str:
    raw = part.get_payload(decode=True)
    try:
        return (raw or b"").decode(charset or "utf-8", errors)
    except LookupError:
        return (raw or b"").decode("utf-8", errors)


def _body(msg, last_plain: bool) -> str:
    """The first plain part, else the first HTML part, in its charset; or the last plain part as UTF-8."""
    if last_plain:
        plain = [p for p in msg.walk() if p.get_content_type() == "text/plain"] if msg.is_multipart() else [msg]
        return _payload(plain[-1], None, "ignore") if plain else ""
    if not msg.is_multipart():
        return _payload(msg, msg.get_content_charset(), "replace")
    for kind in ("text/plain", "text/html"):
        for p in msg.walk():
            if p.get_content_type() == kind:
                return _payload(p, p.get_content_charset(), "replace")
    return ""


def parse_raw(mail: DataFrame, dialect: str = "archive") -> DataFrame:
    """folder, uid, subject, from, to, date, message_id, body of raw messages (folder, uid, raw). Dialects: `archive` joins header
    parts by a blank and takes the first plain or HTML part; `classifier` joins them without and takes the last plain part."""
    joiner, errors, last = (" ", "replace", False) if dialect == "archive" else ("", "ignore", True)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for folder, uid, raw in zip(pdf["folder"], pdf["uid"], pdf["raw"], strict=True):
                m = email.message_from_bytes(bytes(raw or b""))
                head = [_header(m.get(h), joiner, errors) for h in ("Subject", "From", "To")]
                rows.append((folder, uid, *(h.strip() if dialect == "archive" else h for h in head), str(m.get("Date", "")), str(m.get("Message-ID", "")), _body(m, last)))
            yield pd.DataFrame(rows, columns=["folder", "uid", "subject", "from", "to", "date", "message_id", "body"])

    return mail.select("folder", "uid", "raw").mapInPandas(each, "folder string, uid string, subject string, `from` string, `to` string, date string, message_id string, body string")
