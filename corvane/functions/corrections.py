"""Correction rules as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# How spoken technical terms are written, in the order in which they are applied.
SPOKEN_TERMS = {
    "밸리데이션": "validation",
    "벨리데이션": "validation",
    "리엑트": "React",
    "뷰": "Vue",
    "노드": "Node",
    "파이썬": "Python",
    "자바스크립트": "JavaScript",
    "깃허브": "GitHub",
    "디비": "DB",
    "에피아이": "API",
    "유알엘": "URL",
    "제이슨": "JSON",
    "에스큐엘": "SQL",
    "씨유아이": "CUI",
    "지유아이": "GUI",
    "도커": "Docker",
    "쿠버네티스": "Kubernetes",
    "젠킨스": "Jenkins",
    "그래들": "Gradle",
    "마벤": "Maven",
    "레디스": "Redis",
    "몽고": "MongoDB",
    "엘라스틱": "Elasticsearch",
    "카프카": "Kafka",
    "브랜치": "branch",
    "커밋": "commit",
    "풀리퀘스트": "pull request",
    "머지": "merge",
    "체리픽": "cherry-pick",
    "리베이스": "rebase",
    "배포": "deploy",
    "배시": "Bash",
    "템플릿": "template",
    "프레임워크": "framework",
    "라이브러리": "library",
    "인터페이스": "interface",
    "클래스": "class",
    "함수": "function",
    "메서드": "method",
    "변수": "variable",
    "배열": "array",
    "스트링": "string",
    "불린": "boolean",
    "인티저": "integer",
    "플로트": "float",
    "디버그": "debug",
    "로그": "log",
    "에러": "error",
    "익셉션": "exception",
    "콜백": "callback",
    "프로미스": "promise",
    "옵저버": "observer",
    "리팩토링": "refactoring",
    "디자인패턴": "design pattern",
    "알고리즘": "algorithm",
    "옵티마이제이션": "optimization",
    "컴파일": "compile",
    "인터프리터": "interpreter",
    "터미널": "terminal",
    "쉘": "shell",
    "크롬": "Chrome",
    "파이어폭스": "Firefox",
    "사파리": "Safari",
    "위키": "wiki",
    "포크": "fork",
    "스타": "star",
    "이슈": "issue",
    "레포": "repo",
    "레포지토리": "repository",
    "오픈소스": "open source",
    "프라이빗": "private",
    "퍼블릭": "public",
    "클라우드": "cloud",
    "서버": "server",
    "클라이언트": "client",
    "프론트": "front",
    "백엔드": "backend",
    "풀스택": "full stack",
    "미들웨어": "middleware",
    "디펜던시": "dependency",
    "패키지": "package",
    "모듈": "module",
    "플러그인": "plugin",
    "익스텐션": "extension",
    "위젯": "widget",
    "컴포넌트": "component",
    "스타일": "style",
    "레이아웃": "layout",
    "렌더": "render",
    "라우터": "router",
    "스테이트": "state",
    "프롭스": "props",
    "훅": "hook",
    "디스패치": "dispatch",
    "리듀서": "reducer",
    "토큰": "token",
    "쿠키": "cookie",
    "세션": "session",
    "인증": "auth",
    "인가": "authorization",
    "엔드포인트": "endpoint",
    "레스폰스": "response",
    "리퀘스트": "request",
    "페이로드": "payload",
    "헤더": "header",
    "바디": "body",
    "쿼리": "query",
    "파람": "param",
    "테이블": "table",
    "컬럼": "column",
    "로우": "row",
    "인덱스": "index",
    "조인": "join",
    "필터": "filter",
    "소트": "sort",
    "리밋": "limit",
    "오프셋": "offset",
    "캐시": "cache",
    "큐": "queue",
    "스택": "stack",
    "해시": "hash",
    "맵": "map",
    "셋": "set",
    "리스트": "list",
    "튜플": "tuple",
    "딕셔너리": "dictionary",
    "트리": "tree",
    "그래프": "graph",
    "엣지": "edge",
    "버텍스": "vertex",
    "포인터": "pointer",
    "레퍼런스": "reference",
    "객체": "object",
    "인스턴스": "instance",
    "상속": "inheritance",
    "다형성": "polymorphism",
    "캡슐화": "encapsulation",
    "추상화": "abstraction",
}
# Fixed value: what ends a word on either side of an alias.
WORD = "0-9A-Za-z가-힣"


@dataclass(frozen=True)
class Exact:
    """Replace a literal string wherever it stands."""

    old: str
    new: str
    enabled: bool = True


@dataclass(frozen=True)
class Alias:
    """Replace variants by the canonical form where they stand as words."""

    canonical: str
    variants: tuple[str, ...]
    category: str | None = None
    enabled: bool = True


def _active(rules: Sequence[Exact]) -> list[tuple[str, str]]:
    cleaned = [(r.old.strip(), r.new.strip()) for r in rules if r.enabled]
    return [(a, b) for a, b in cleaned if a and a != b]


def _variants(rules: Sequence[Alias]) -> list[tuple[str, str, str | None]]:
    """(variant, canonical, category) in the order applied: rule by rule, the longest variant first."""
    out = []
    for r in rules:
        canonical = r.canonical.strip()
        if r.enabled and canonical:
            own = dict.fromkeys(v.strip() for v in r.variants if v.strip() and v.strip() != canonical)
            out += [(v, canonical, r.category) for v in sorted(own, key=len, reverse=True)]
    return out


def _java_literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def apply_exact(text: Column, rules: Sequence[Exact]) -> Column:
    """All rules in order; a later rule sees what an earlier one wrote."""
    for old, new in _active(rules):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def apply_aliases(text: Column, rules: Sequence[Alias]) -> Column:
    for variant, canonical, _ in _variants(rules):
        text = F.regexp_replace(text, rf"(?<![{WORD}])\Q{variant}\E(?![{WORD}])", _java_literal(canonical))
    return text


def corrected(text: Column, exact: Sequence[Exact], aliases: Sequence[Alias]) -> Column:
    """Struct of the corrected text and its changes (type, from, to, count), each counted at its own step."""
    steps = [("exact", re.escape(a), a, b) for a, b in _active(exact)]
    steps += [("alias", rf"(?<![{WORD}]){re.escape(v)}(?![{WORD}])", v, c) for v, c, _ in _variants(aliases)]
    empty = F.array().cast("array<struct<type:string,from:string,to:string,count:int>>")
    if not steps:
        return F.struct(text.alias("text"), empty.alias("changes"))
    rules = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(_java_literal(b)).alias("b"), F.lit(b).alias("to")) for k, p, a, b in steps])

    def step(acc: Column, r: Column) -> Column:
        n = F.regexp_count(acc["text"], r["p"])
        change = F.array(F.struct(r["k"].alias("type"), r["a"].alias("from"), r["to"].alias("to"), n.alias("count")))
        return F.struct(F.regexp_replace(acc["text"], r["p"], r["b"]).alias("text"), F.when(n > 0, F.concat(acc["changes"], change)).otherwise(acc["changes"]).alias("changes"))

    return F.aggregate(rules, F.struct(text.alias("text"), empty.alias("changes")), step)


def quick_fix(text: Column, terms: dict[str, str] | None = None) -> Column:
    """Spoken terms between white space or punctuation become written ones. Texts without Hangul are left alone at once."""
    out = text
    for spoken, written in (SPOKEN_TERMS if terms is None else terms).items():
        out = F.regexp_replace(out, rf"(?U)(?<=^|[\s,.!?])\Q{spoken}\E(?=[\s,.!?]|\z)", _java_literal(written))
    return F.when(F.regexp_like(text, F.lit("[가-힣]")), out).otherwise(text) if terms is None else out


def correct(text: Column, mode: str = "quick", terms: dict[str, str] | None = None) -> Column:
    """The modes quick and llm do the quick fix; any other mode leaves the text as it is."""
    return quick_fix(text, terms) if mode in ("quick", "llm") else text


def merged_variants(canonical: Column, old: Column, new: Column) -> Column:
    """Old and new variants, each once, without the canonical form."""
    return F.array_except(F.array_distinct(F.concat(old, new)), F.array(canonical))
