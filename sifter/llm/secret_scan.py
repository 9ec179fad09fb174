"""Secret scans: pattern rules and sliding-window Shannon entropy, in DataFrame functions only.

Base rules find assignments, access keys and hex digests. Besides, every maximal run of
token characters of at least ``min_run`` is a candidate, of the first class that has all of its
symbols: hex, alphanumeric, base64, or any token. A window slides over it. The counts of its
symbols, five bits each, and the sum of c * log2(c) over them, as whole numbers, are kept up to
date from the symbol that leaves and the one that enters. A candidate is reported when some window
reaches its class's bits of entropy. Candidates that an allow-list pattern matches whole, or that
lie in a base span, are suppressed; base spans always stay.

Spans are ``kind:start:end`` in code points, the end exclusive. A null text is taken as empty; very
long texts are scanned whole; spans that start together come in the order of their kinds; rows are
independent, so that repeated rows and null or repeated ids each get a row; an empty table gives
none; the input's other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import let

#: The base kinds in their order, each with its pattern and the least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64", "entropy_token")
#: The symbols of candidates, and the classes in order: their kind's number and what they consist of.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CLASSES = ((3, "^[0-9a-fA-F]+$"), (4, "^[A-Za-z0-9]+$"), (5, "^[A-Za-z0-9+/=]+$"), (6, "^.*$"))
_BITS = 5  # of a count; windows are shorter than 2 ** 5
_PER_LONG = 63 // _BITS


@dataclass(frozen=True)
class SecretScan:
    """Parameters; the defaults are those of the registered query."""

    min_run: int = 24
    window: int = 24
    hex_bits: float = 3.0
    alnum_bits: float = 4.0
    base64_bits: float = 4.0
    token_bits: float = 4.0
    min_value: int = 8
    #: Candidates that one of these matches whole are no secrets: numbers, words and words
    #: joined by marks, rules of marks, UUIDs.
    allow: tuple[str, ...] = (
        "[0-9]+",
        "[A-Za-z]?[a-z/_=+-]+",
        "[A-Z/_=+-]+",
        "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    )

    def __post_init__(self) -> None:
        if not 1 < self.window < 1 << _BITS or self.min_run < self.window:
            raise ValueError("a window has 2 to 31 symbols, and no candidate is shorter")

    def bits(self) -> tuple[float, ...]:
        """The least entropy of each class."""
        return (self.hex_bits, self.alnum_bits, self.base64_bits, self.token_bits)

    def allowed(self) -> str:
        return "^(?:" + "|".join(f"(?:{x})" for x in self.allow) + ")$"

    def units(self) -> list[int]:
        """c * log2(c) for each count c of a window, in millionths."""
        return [0] + [round(c * math.log2(c) * 1e6) for c in range(1, self.window + 1)]

    def most(self, bits: float) -> int:
        """The largest sum of units at which a window's entropy is at least `bits`."""
        return math.floor(self.window * (math.log2(self.window) - bits) * 1e6)


def _placed(text: Column, pattern: str, kind: int) -> Column:
    """Matches of a pattern in order: structs of s, e, k (kind's number) and the matched m.

    The pieces between the matches give the positions. Sums run over blocks of 256 matches,
    so that the cost stays near linear in a text with very many matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m"))
    span = "struct<s:int,e:int,k:int,m:string>"

    def block(pos: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(pos.alias("pos"), F.array().cast(f"array<{span}>").alias("out")),
            lambda acc, x: let(
                acc["pos"] + F.length(x["p"]),
                lambda s: F.struct(
                    (s + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"),
                    F.concat(
                        acc["out"],
                        F.array(F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), F.lit(kind).alias("k"), x["m"].alias("m"))),
                    ).alias("out"),
                ),
            ),
        )

    def all_blocks(pairs: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), ((F.size(pairs) - 1) / 256).cast("int")),
            F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{span}>>").alias("out")),
            lambda acc, b: let(
                block(acc["pos"], F.slice(pairs, b * 256 + 1, 256)),
                lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")),
            ),
            lambda acc: F.flatten(acc["out"]),
        )

    none = F.array().cast(f"array<{span}>")
    return F.when(text.rlike(pattern), F.filter(let(pair, all_blocks), lambda x: x["m"].isNotNull())).otherwise(none)


def least_units(text: Column, scan: SecretScan) -> Column:
    """The least sum of c * log2(c) over all windows of a string of at least window symbols.

    Each step costs the same, however long the window: one symbol's count goes down, one's goes up.
    """
    w, units = scan.window, F.array(*[F.lit(u) for u in scan.units()])
    longs = -(-len(SYMBOLS) // _PER_LONG)
    word = lambda symbol: (symbol / _PER_LONG).cast("int")
    place = lambda symbol: symbol % _PER_LONG * _BITS
    one = lambda symbol: F.call_function("shiftleft", F.lit(1).cast("long"), place(symbol))

    def count(counts: Column, symbol: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, word(symbol)), place(symbol)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def change(c: Column, by: int) -> Column:
        return F.get(units, c + by) - F.get(units, c)

    def moved(counts: Column, symbol: Column, by: int) -> Column:
        return F.transform(counts, lambda v, k: F.when(k == word(symbol), v + by * one(symbol)).otherwise(v))

    def step(symbols: Column, acc: Column, i: Column) -> Column:
        """Symbol i (from 1) enters; from i > window on, symbol i - window leaves first."""
        enters, leaves = F.get(symbols, i - 1), F.get(symbols, i - 1 - w)
        gone = F.when(
            i > w, F.struct((acc["sum"] + change(count(acc["counts"], leaves), -1)).alias("sum"), moved(acc["counts"], leaves, -1).alias("counts"))
        ).otherwise(F.struct(acc["sum"].alias("sum"), acc["counts"].alias("counts")))
        return let(
            gone,
            lambda g: let(
                g["sum"] + change(count(g["counts"], enters), 1),
                lambda now: F.struct(
                    now.alias("sum"),
                    F.when(i >= w, F.least(acc["best"], now)).otherwise(acc["best"]).alias("best"),
                    moved(g["counts"], enters, 1).alias("counts"),
                ),
            ),
        )

    return let(
        F.transform(F.split(text, ""), lambda c: F.call_function("locate", c, F.lit(SYMBOLS)) - 1),
        lambda symbols: F.aggregate(
            F.sequence(F.lit(1), F.length(text)),
            F.struct(F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("best"), F.array_repeat(F.lit(0).cast("long"), longs).alias("counts")),
            lambda acc, i: step(symbols, acc, i),
            lambda acc: acc["best"],
        ),
    )


def scan_secrets(
    docs: DataFrame,
    scan: SecretScan = SecretScan(),
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every document with its spans: arrays of structs s, e, k, m in `base` and `extra`."""
    out = docs.select(
        F.col(id_col).alias(id_col),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("string").alias("carried"),
    )
    text = F.col("text")
    run = f"[A-Za-z0-9+/_=-]{{{scan.min_run},}}"
    out = out.select(
        "*",
        _placed(text, ASSIGN, 0).alias("assign"),
        _placed(text, ACCESS, 1).alias("access"),
        _placed(text, HEX, 2).alias("hex"),
        _placed(text, run, 3).alias("runs"),
    )
    out = out.withColumn(
        "assign",
        F.filter("assign", lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= scan.min_value),
    )
    out = out.withColumn("base", F.concat("assign", "access", "hex")).withColumn("runs", F.filter("runs", lambda x: ~x["m"].rlike(scan.allowed())))
    inside = lambda x: F.exists("base", lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"]))
    out = out.withColumn("runs", F.filter("runs", lambda x: ~inside(x)))

    def judged(x: Column) -> Column:
        found = F.lit(None).cast("int")
        for (k, symbols), bits in reversed(list(zip(CLASSES, scan.bits(), strict=True))):
            found = F.when(x["m"].rlike(symbols), F.when(x["k"] <= scan.most(bits), F.lit(k))).otherwise(found)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), found.alias("k"), x["m"].alias("m"))

    def measured(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), least_units(x["m"], scan).alias("k"), x["m"].alias("m"))

    out = out.withColumn("extra", F.when(F.size("runs") > 0, F.filter(F.transform(F.transform("runs", measured), judged), lambda x: x["k"].isNotNull())).otherwise(F.col("runs")))
    return out.select(id_col, "text", *([F.col("carried")] if carry else []), "base", "extra")


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the base spans' SHA-256 and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "extra")).alias("spans"),
    )


def redacted(found: DataFrame, mark: str = "[secret]") -> Column:
    """The text with every stretch that spans cover replaced by the mark."""
    spans = F.sort_array(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    text = F.col("text")
    out = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.when(x["e"] <= acc["pos"], acc).otherwise(
            F.struct(
                x["e"].alias("pos"),
                F.when(
                    x["s"] >= acc["pos"],  # else it goes on where the last one ended
                    F.concat(acc["parts"], F.array(F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), F.lit(mark))),
                )
                .otherwise(acc["parts"])
                .alias("parts"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["pos"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, out).otherwise(text)


def sql(scan: SecretScan = SecretScan(), table: str = "documents") -> str:
    """The digest in DuckDB SQL; every window's entropy is computed anew from its counts."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    patterns = ", ".join(f"({k}, {q(p)})" for k, p in enumerate((ASSIGN, ACCESS, HEX, f"[A-Za-z0-9+/_=-]{{{scan.min_run},}}")))
    names = "[" + ", ".join(q(k) for k in KINDS) + "]"
    kinds = " ".join(f"WHEN regexp_matches(s, {q(symbols)}) THEN {k}" for k, symbols in CLASSES)
    mosts = " ".join(f"WHEN {k} THEN {scan.most(bits)}" for (k, _), bits in zip(CLASSES, scan.bits(), strict=True))
    joined = lambda f: f"coalesce(string_agg({names}[k + 1] || ':' || b || ':' || e, ',' ORDER BY b, k){f}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
p(k, p) AS (VALUES {patterns}),
m AS (SELECT rid, k, regexp_extract_all(t, p) AS ms, string_split_regex(t, p) AS ps FROM d, p),
x AS (SELECT rid, k, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m),
y AS (SELECT rid, k, ms[i] AS s,
        CAST(list_sum([length(v) FOR v IN ps[1:i]]) + coalesce(list_sum([length(v) FOR v IN ms[1:i - 1]]), 0) AS BIGINT) AS b FROM x),
z AS (SELECT *, b + length(s) AS e FROM y),
base AS (SELECT rid, k, b, e FROM z WHERE k IN (1, 2)
        OR k = 0 AND length(regexp_replace(s, {q(ASSIGN_HEAD)}, '')) >= {scan.min_value}),
c AS (SELECT row_number() OVER () AS cid, * FROM z WHERE k = 3 AND NOT regexp_matches(s, {q(scan.allowed())})
        AND NOT EXISTS (FROM base WHERE base.rid = z.rid AND base.b <= z.b AND base.e >= z.e)),
o AS (SELECT cid, s, unnest(range(1, length(s) - {scan.window} + 2)) AS o FROM c),
ch AS (SELECT cid, o, substr(s, o + j, 1) AS ch FROM (SELECT *, unnest(range(0, {scan.window})) AS j FROM o)),
n AS (SELECT cid, o, ch, count(*) AS n FROM ch GROUP BY ALL),
u AS (SELECT cid, o, sum(CAST(round(n * log2(n) * 1e6) AS BIGINT)) AS u FROM n GROUP BY ALL),
best AS (SELECT cid, min(u) AS u FROM u GROUP BY cid),
extra AS (SELECT rid, k, b, e FROM (SELECT c.rid, c.b, c.e, u, CASE {kinds} END AS k FROM c JOIN best USING (cid)) WHERE u <= CASE k {mosts} END),
spans AS (FROM base UNION ALL FROM extra)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
        count(*) FILTER (k = 2) AS n_hex, sha256({joined(" FILTER (k < 3)")}) AS base_sha256, {joined("")} AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY rid"""
