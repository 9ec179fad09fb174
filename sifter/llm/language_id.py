"""Language identification: words first, then ever shorter character n-grams.

Words are a letter and the letters and marks after it, in the lower-cased text. The model holds,
for every word of the training texts, its log frequency in each language, and likewise for every
character n-gram (of the word between two marks) of each order. A known word scores by its log
frequencies. An unseen one scores by the mean over its known n-grams of the longest order that has
any, and by nothing if none has. A text's language is the one with the largest sum, ties going to
the language with more training tokens, then by name. The score is the softmax of the mean word
score times at most ``sharpness`` words.

Counts are taken over all training rows and nothing is left out of the model, which is a table.
Each text is read twice: to count, and to look its words up. The most frequent words, as many as
``frequent_bytes`` hold, are broadcast and add up where the text is; that is a matter of speed
alone. All other words meet the model in a join, and what they add comes back by document. What
follows from the size of the training texts is subtracted at the end, so that counts travel.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any text where
no language was learned; rows without text or language are not learned from; repeated rows each
get a row; very long texts are taken whole; an empty table gives no rows; other columns are
ignored unless named in ``carry``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import arrow_rows, held_out, staged

UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: What lies between ASCII characters that are no letters, in lower case: mostly just a word.
_RUN = re.compile(r"[^\x00-`{-\x7f]+")


@dataclass(frozen=True)
class LanguageId:
    """Parameters; the defaults are those of the registered query."""

    fold: int = 5
    orders: tuple[int, ...] = (4, 3, 2, 1)
    smoothing: float = 0.5
    sharpness: int = 20
    #: Bound of the broadcast table of frequent words in a worker, whatever the number of languages.
    frequent_bytes: int = 48 << 20
    #: Rows that a worker gets at once.
    batch_rows: int = 2000


def words_in(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language: `tables[0]` of words, `tables[n]` of n-grams."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, np.ndarray]], spec: LanguageId) -> None:
        self.langs, self.tables, self.spec = langs, tables, spec

    def word(self, word: str) -> np.ndarray:
        found = self.tables[0].get(word)
        if found is not None:
            return found
        for n in self.spec.orders:
            known = [v for v in map(self.tables[n].get, grams_of(word, n)) if v is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))


class Learned:
    """Counts by language of words (key, c0, c1, ...) and of n-grams, and what they are divided by.

    bases[n][i] is subtracted from the log of a smoothed count of order n (0: words) in language i.
    """

    def __init__(self, langs: list[str], words: DataFrame, grams: DataFrame, totals: list[tuple], spec: LanguageId) -> None:
        self.langs, self.words, self.grams, self.spec = langs, words, grams, spec
        self.counts = [f"c{i}" for i in range(len(langs))]
        #: By about an eighth of a doubling of a word's count: (step, words, sums by language).
        self.totals = totals

    def _base(self, keys: int, sums: list[int]) -> list[float]:
        return [float(np.log(n + self.spec.smoothing * (keys + 1))) for n in sums]

    @cached_property
    def bases(self) -> dict[int, list[float]]:
        out = {0: self._base(sum(t[1] for t in self.totals), [sum(t[2 + i] for t in self.totals) for i in range(len(self.langs))])}
        rows = self.grams.groupBy(F.char_length("key").alias("order")).agg(F.count(F.lit(1)).alias("keys"), *[F.sum(c).alias(c) for c in self.counts]).collect()
        return out | {r.order: self._base(r["keys"], [r[c] for c in self.counts]) for r in rows}

    @cached_property
    def tables(self) -> dict[int, dict[str, np.ndarray]]:
        """All of the model on the driver: to look at small ones."""
        out: dict[int, dict[str, np.ndarray]] = {n: {} for n in (0, *self.spec.orders)}
        for table, order in ((self.words, lambda k: 0), (self.grams, len)):
            for r in table.collect():
                n = order(r["key"])
                out[n][r["key"]] = np.log(np.array([r[c] for c in self.counts]) + self.spec.smoothing) - np.array(self.bases[n])
        return out

    def frequent(self) -> Frequent:
        """The words counted most, as many steps of them as the bound allows."""
        room, least = self.spec.frequent_bytes // (8 * len(self.langs) + 160), None
        for step, words, *_ in sorted(self.totals, reverse=True):
            room -= words
            if room < 0:
                break
            least = step
        if least is None:
            return Frequent([], np.zeros((0, len(self.langs))))
        rows = self.words.filter(_step(self.counts) >= least).toArrow()
        return Frequent(rows.column("key").to_pylist(), np.log(np.stack([rows.column(c).to_numpy() for c in self.counts], axis=1) + self.spec.smoothing))


class Frequent:
    """Words and the logs of their smoothed counts; a worker numbers the words once."""

    def __init__(self, words: list[str], logs: np.ndarray) -> None:
        self.words, self.logs = words, logs

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}


def _step(counts: list[str]) -> Column:
    return F.floor(F.log2(sum((F.col(c) for c in counts), F.lit(0))) * 8).cast("int")


def _count_words(langs: list[str]):
    names = ["key", *(f"c{i}" for i in range(len(langs)))]
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in langs]

        def rows() -> pa.RecordBatch:
            """The words of all languages; runs of other characters than letters are words of their parts."""
            for c in counts:
                for run in [r for r in c if not r.isalpha()]:
                    n = c.pop(run)
                    for w in _WORD.findall(run):
                        c[w] += n
            words = list(dict.fromkeys(w for c in counts for w in c))
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array(np.fromiter(map(lambda w, c=c: c.get(w, 0), words), np.int64, len(words))) for c in counts)], names
            )

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[place[lang]].update(_RUN.findall(text.lower()))
            if sum(map(len, counts)) > 1_000_000:
                yield rows()
                counts = [Counter() for _ in langs]
        yield rows()

    return count


def _count_grams(orders: tuple[int, ...], names: list[str]):
    """Counts of the n-grams of words (key, c0, ...), each as often as the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by("key").aggregate([(c, "sum") for c in names])
            return t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(["key", *names])

        for batch in batches:
            marked = [f"<{w}>" for w in batch.column(0).to_pylist()]
            grams = [m[i : i + n] for n in orders for m in marked for i in range(len(m) - n + 1)]
            sizes = np.fromiter(map(len, marked), np.int64, len(marked))
            word = np.concatenate([np.repeat(np.arange(len(marked)), np.maximum(sizes - n + 1, 0)) for n in orders])
            held.append(pa.table([pa.array(grams, pa.string()), *(pa.array(batch.column(k + 1).to_numpy()[word]) for k in range(len(names)))], ["key", *names]))
            if sum(t.num_rows for t in held) > 2_000_000:
                held = [summed()]
        if held:
            yield from summed().combine_chunks().to_batches()

    return count


def fit(docs: DataFrame, spec: LanguageId = LanguageId(), text_col: str = "text", lang_col: str = "lang") -> Learned:
    """Learn from all rows of docs that have a text and a language."""
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    names = [f"c{i}" for i in range(len(langs))]
    schema = ", ".join(["key string", *(f"{c} long" for c in names)])
    sums = [F.sum(c).alias(c) for c in names]
    counted = known.mapInArrow(_count_words(langs), schema).groupBy("key").agg(*sums) if langs else known.select(F.col("lang").alias("key")).limit(0)
    counted = staged(counted)
    if not langs:
        return Learned([], counted, counted, [], spec)
    totals = [tuple(r) for r in counted.groupBy(_step(names).alias("step")).agg(F.count(F.lit(1)).alias("words"), *sums).collect()]
    tokens = [sum(t[2 + i] for t in totals) for i in range(len(langs))]
    # Languages with more tokens first; one whose texts hold no word at all is not learned.
    order = sorted((i for i in range(len(langs)) if tokens[i]), key=lambda i: (-tokens[i], langs[i]))
    words = counted.select("key", *[F.col(f"c{i}").alias(f"c{k}") for k, i in enumerate(order)])
    names = names[: len(order)]
    grams = words.mapInArrow(_count_grams(spec.orders, names), ", ".join(["key string", *(f"{c} long" for c in names)]))
    grams = staged(grams.groupBy("key").agg(*[F.sum(c).alias(c) for c in names])) if order else words
    return Learned([langs[i] for i in order], words, grams, [(t[0], t[1], *(t[2 + i] for i in order)) for t in totals], spec)


def _unseen_scores(words: DataFrame, model: Learned) -> DataFrame:
    """key, order and v0, v1, ..., the mean logs of its n-grams' smoothed counts, of every word with a known one."""
    spec, out = model.spec, None
    left = staged(words)
    for n in spec.orders:

        def grams(batches: Iterator[pa.RecordBatch], n: int = n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(w, g, k) for w in batch.column(0).to_pylist() for g, k in Counter(grams_of(w, n)).items()]
                columns = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "key", "k"])

        of_order = model.grams.filter(F.char_length("key") == n)
        mean = [(F.sum(F.log(F.col(c) + spec.smoothing) * F.col("k")) / F.sum("k")).alias(f"v{i}") for i, c in enumerate(model.counts)]
        found = staged(left.mapInArrow(grams, "word string, key string, k long").join(of_order, "key").groupBy("word").agg(*mean).withColumn("order", F.lit(n)))
        out = found if out is None else out.unionByName(found)
        if n != spec.orders[-1]:
            left = staged(left.join(found.select(F.col("word").alias("key")), "key", "left_anti"))
    return out.withColumnRenamed("word", "key")


def predict(docs: DataFrame, model: Learned, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, lang_pred, score and the carried columns of every row; the text alone decides."""
    spec, langs, width = model.spec, model.langs, len(model.langs)
    read = f"carried_{text_col}" if text_col in carry else "text__"  # a text that is carried is sent once
    texts = [F.col(text_col).alias(read)] if read == "text__" else []
    kept = docs.select(*texts, F.col(id_col), held_out(id_col, spec.fold).alias("held_out"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    names = [c for c in kept.columns if c != "text__"]
    if not langs:
        return kept.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent())  # frequent_bytes at most

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words, those known here and the sums of their logs, and the other words of each text."""
        table = shared.value
        get, logs = table.number.get, np.vstack([table.logs, np.zeros(width)])  # the last for other words
        for batch in batches:
            many, known, sums, rare, times = [], [], [], [], []
            for text in batch.column(read):
                runs = _RUN.findall((text.as_py() or "").lower())
                at = [get(r, -1) for r in runs]
                other: Counter = Counter()
                if -1 in at:
                    other.update(r for r, i in zip(runs, at, strict=True) if i < 0)
                    at = [i for i in at if i >= 0]
                    for run in [r for r in other if not r.isalpha()]:
                        n = other.pop(run)
                        for w in _WORD.findall(run):
                            i = get(w, -1)
                            if i < 0:
                                other[w] += n
                            else:
                                at += [i] * n
                many.append(len(at) + sum(other.values()))
                known.append(len(at))
                sums.append(logs[at].sum(axis=0) if at else logs[-1])
                rare.append(list(other))
                times.append(list(other.values()))
            made = [pa.array(many, pa.int64()), pa.array(known, pa.int64()), *(pa.array([s[i] for s in sums], pa.float64()) for i in range(width)), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            through = [c for c in batch.schema.names if c != "text__"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in through), *made], [*through, "words__", "known__", *(f"s{i}__" for i in range(width)), "rare__", "times__"])

    numbered = kept.select(*["text__"] * (read == "text__"), F.monotonically_increasing_id().alias("row__"), *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "text__")
    schema += ", words__ long, known__ long, " + ", ".join(f"s{i}__ double" for i in range(width)) + ", rare__ array<string>, times__ array<long>"
    with arrow_rows(docs.sparkSession, spec.batch_rows):
        texts = staged(numbered.mapInArrow(looked_up, schema))
    # The other words meet the counts; they come back by document as sums, and as unseen words.
    rare = texts.select("row__", F.explode(F.arrays_zip("rare__", "times__")).alias("z")).select("row__", F.col("z.rare__").alias("key"), F.col("z.times__").alias("k"))
    met = rare.join(model.words, "key", "left")
    seen = F.col("c0").isNotNull()
    log = lambda c: F.log(F.col(c) + spec.smoothing)
    back = (
        met.select("row__", "k", F.when(~seen, F.col("key")).alias("key"), *model.counts)
        .repartition("row__")
        .groupBy("row__")
        .agg(
            F.sum(F.when(seen, F.col("k"))).alias("n0"),
            *[F.sum(F.when(seen, F.col("k") * log(c))).alias(f"t{i}") for i, c in enumerate(model.counts)],
            F.collect_list(F.when(~seen, F.struct("key", "k"))).alias("unseen"),
        )
    )
    back = staged(back)
    unseen = back.select("row__", F.explode("unseen").alias("z")).select("row__", "z.key", "z.k")
    spelt = staged(unseen.join(_unseen_scores(unseen.select("key").distinct(), model), "key"))
    by_row = [F.sum(F.col("k") * F.col(f"v{i}")).alias(f"u{i}") for i in range(width)]
    spelt = spelt.groupBy("row__").agg(*by_row, *[F.sum(F.when(F.col("order") == n, F.col("k"))).alias(f"n{n}") for n in spec.orders])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    by_order = {0: F.col("known__") + zero("n0")} | {n: zero(f"n{n}") for n in spec.orders}
    mean = [
        F.round((zero(f"s{i}__") + zero(f"t{i}") + zero(f"u{i}") - sum((by_order[n] * b[i] for n, b in model.bases.items()), F.lit(0.0))) / F.greatest(F.col("words__"), F.lit(1)), 9)
        for i in range(width)
    ]
    summed = texts.drop("rare__", "times__").join(back.drop("unseen"), "row__", "left").join(spelt, "row__", "left").select(*names, "words__", F.array(*mean).alias("mean__"))
    best = F.array_max("mean__")
    some = F.col("words__") > 0
    return summed.select(
        *names,
        F.when(some, F.array(*map(F.lit, langs))[F.array_position("mean__", best).cast("int") - 1]).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, 1 / F.aggregate("mean__", F.lit(0.0), lambda a, x: a + F.exp((x - best) * F.least(F.col("words__"), F.lit(spec.sharpness))))).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame, spec: LanguageId = LanguageId(), id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the rows outside the held-out fold and label every row."""
    return predict(docs, fit(docs.filter(~held_out(id_col, spec.fold)), spec), id_col, carry=carry)
