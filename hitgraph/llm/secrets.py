"""Secret scans by trigram queries, in DataFrame functions alone.

From each rule's regex a Boolean query over trigrams is derived (an OR of ANDs of trigrams that any match must hold,
in lower case).  The index's postings are kept beside the rows, one bit for each trigram that any query names, so
intersecting postings is an AND of masks; documents that satisfy a rule's query are candidates, and its regex
verifies them.  A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Strings that a stretch of a pattern may spell, at most; beyond, it counts as unknown (the query only gets weaker).
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind, Java regex; least: characters of the group (0: the match) that a match needs.

    Patterns keep to what Java, RE2 and Python read alike, letters of either case are written as classes.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
#: The order is that of kinds in results.
BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams; [frozenset()] is true for every text."""
    return _simple(_sequence(sre_parse.parse(pattern)))


def _and(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    out = {x | y for x in a for y in b}
    return _simple(list(out)) if len(out) <= MOST_STRINGS else min(a, b, key=len)


def _simple(dnf: list[frozenset[str]]) -> list[frozenset[str]]:
    return sorted((x for x in {*dnf} if not any(y < x for y in dnf)), key=sorted)


def _of(strings: set[str]) -> list[frozenset[str]]:
    return _simple([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _sequence(nodes) -> list[frozenset[str]]:
    """The query of a sequence: spelled stretches give trigrams, other parts their own queries."""
    out, spelled = [frozenset()], {""}
    for node in nodes:
        exact = _spell(node)
        if exact is not None and len(exact) * len(spelled) <= MOST_STRINGS:
            spelled = {a + b for a, b in product(spelled, exact)}
            continue
        out, spelled = _and(out, _of(spelled)), {""}
        if exact is not None:
            spelled = exact
            continue
        kind, what = node
        if kind is sre.SUBPATTERN:
            out = _and(out, _sequence(what[3]))
        elif kind is sre.BRANCH:
            out = _and(out, _simple([x for b in what[1] for x in _sequence(b)]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and what[0] > 0:
            out = _and(out, _sequence(what[2]))
    return _and(out, _of(spelled))


def _spell(node) -> set[str] | None:
    """All lower-case strings that a part can match, None if unknown or many."""
    kind, what = node
    if kind is sre.LITERAL:
        return {chr(what).lower()}
    if kind is sre.AT:
        return {""}
    if kind is sre.IN:
        got = set()
        for k, v in what:
            if k is sre.LITERAL:
                got.add(chr(v).lower())
            elif k is sre.RANGE and v[1] - v[0] < 8:
                got |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return got if len(got) <= 8 else None
    if kind is sre.SUBPATTERN:
        return _all(what[3])
    if kind is sre.BRANCH:
        parts = [_all(b) for b in what[1]]
        return None if None in parts else set().union(*parts)
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = what
        one = _all(inner)
        if one is None or high > 6:
            return None
        got, now = set(), {""}
        for k in range(high + 1):
            if k >= low:
                got |= now
            now = {a + b for a, b in product(now, one)}
            if len(now) > MOST_STRINGS:
                return None
        return got
    return None


def _all(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        one = _spell(n)
        if one is None or len(one) * len(out) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, one)}
    return out


def _postings(text: Column, trigrams: list[str]) -> Column:
    """Bits of the trigrams that a text holds, 62 a word."""
    low = F.lower(text)
    words = []
    for i in range(0, max(len(trigrams), 1), 62):
        bits = [F.when(F.contains(low, F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(trigrams[i : i + 62])]
        word = F.lit(0).cast("long")
        for b in bits:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def _candidate(bits: Column, dnf: list[frozenset[str]], trigrams: list[str]) -> Column:
    out = F.lit(False)
    for conj in dnf:
        ok = F.lit(True)
        for w in range((len(trigrams) + 61) // 62):
            mask = sum(1 << k for k, t in enumerate(trigrams[62 * w : 62 * w + 62]) if t in conj)
            if mask:
                ok = ok & (bits[w].bitwiseAND(F.lit(mask)) == F.lit(mask))
        out = out | ok
    return out


_NONE = "cast(array() as array<struct<start:bigint,kind_no:int,kind:string,stop:bigint>>)"


def _spans(rule: Rule, number: int) -> Column:
    """Places of the rule's matches, from the stretches between them; failing matches drop out afterwards."""
    p = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    hits = f"regexp_extract_all(text, '{p}', 0)"
    groups = f"regexp_extract_all(text, '{p}', {rule.group})"
    every = f"""zip_with(slice(split(text, '{p}', -1), 1, size({hits})), zip_with({hits}, {groups}, (h, g) -> struct(h as h, g as g)),
        (a, b) -> struct(char_length(a) as gap, char_length(b.h) as len, char_length(b.g) as need))"""
    # sums from the left by parts of 256, then inside each part: linear up to some 10 ** 5 matches, and no text is too long
    # the one-element array binds the matches to a name: a lambda's body would run the expression anew for each part
    parts = f"transform(array({every}), e -> transform(sequence(0, greatest(size(e) - 1, 0) div 256), c -> slice(e, c * 256 + 1, 256)))[0]"
    placed = """aggregate(PARTS, struct(0L as at, cast(array() as array<struct<at:bigint,xs:array<struct<gap:int,len:int,need:int>>>>) as found),
        (acc, xs) -> struct(acc.at + aggregate(xs, 0L, (n, x) -> n + x.gap + x.len) as at, concat(acc.found, array(struct(acc.at as at, xs as xs))) as found)).found"""
    inside = f"""aggregate(p.xs, struct(p.at as at, cast(array() as array<struct<start:bigint,kind_no:int,kind:string,stop:bigint,need:int>>) as found),
        (acc, x) -> struct(acc.at + x.gap + x.len as at, concat(acc.found, array(struct(acc.at + x.gap as start, {number} as kind_no, '{rule.kind}' as kind, acc.at + x.gap + x.len as stop, x.need as need))) as found)).found"""
    return F.expr(f"filter(flatten(transform({placed.replace('PARTS', parts)}, p -> {inside})), x -> x.need >= {rule.least})")


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans as kind:start:end.

    Places are code points, ends exclusive.  Null texts count as empty; repeated rows give repeated rows; a text
    without finds has the digest of the empty string.  Row by row: no shuffle, no Python.
    """
    rules = [*base, *more]
    queries = {r.kind: query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("bits", _postings(F.col("text"), trigrams))
    found = rows.select(
        "doc_id",
        *[
            F.when(_candidate(F.col("bits"), queries[r.kind], trigrams) & F.expr("text rlike '" + r.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"), _without_need(_spans(r, k))).otherwise(F.expr(_NONE)).alias(f"s_{r.kind}")
            for k, r in enumerate(rules)
        ],
    )

    def joined(kinds: list[str]) -> Column:
        every = F.array_sort(F.concat(*[F.col(f"s_{k}") for k in kinds])) if len(kinds) > 1 else F.col(f"s_{kinds[0]}")
        return F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    return found.select(
        "doc_id",
        *[F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(joined([r.kind for r in base]).cast("binary"), 256).alias("base_sha256"),
        joined([r.kind for r in rules]).alias("spans"),
    )


def _without_need(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["kind"].alias("kind"), x["stop"].alias("stop")))


def _sql() -> str:
    """The same for DuckDB: places from the pieces between matches."""
    cols, base, every = [], [], []
    for k, r in enumerate([*BASE, *MORE]):
        p = r.pattern.replace("'", "''")
        cols.append(f"regexp_extract_all(t, '{p}') AS h{k}, regexp_extract_all(t, '{p}', {r.group}) AS g{k}, string_split_regex(t, '{p}') AS p{k}")
        one = f"""list_transform(list_filter(range(1, len(h{k}) + 1), lambda i: length(g{k}[i]) >= {r.least}), lambda i: {{'s': list_sum(list_transform(p{k}[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h{k}[1:i - 1], lambda x: length(x))), 0)::BIGINT, 'k': {k}, 'n': '{r.kind}', 'l': length(h{k}[i])}})"""
        every.append(one)
    names = [f"f{k}" for k in range(len(every))]
    text = lambda xs: f"coalesce(array_to_string(list_transform(list_sort({' || '.join(xs)}), lambda x: x.n || ':' || x.s || ':' || (x.s + x.l)), ','), '')"
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, {', '.join(cols)} FROM a),
c AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for e, n in zip(every, names))} FROM b)
SELECT doc_id, len(f0)::BIGINT AS n_assign, len(f1)::BIGINT AS n_access, len(f2)::BIGINT AS n_hex, sha256({text(names[:3])}) AS base_sha256, {text(names)} AS spans FROM c"""


SQL = _sql()


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
