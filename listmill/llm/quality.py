"""Quality by perplexity: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model reads a word as its characters between a start and an end mark and predicts each from the ORDER - 1 before it;
there is one model for each language. Counts, continuation counts, discounts and interpolated probabilities are built by
grouped sums and joins on (language, n-gram), which Spark deals over shards. To score documents they are dealt into blocks;
each block asks for its distinct n-grams, one join with the sharded model answers them, and the block's documents are
scored with the answers. A document is rejected if its perplexity exceeds its language's limit, the HIGH quantile of the
held-out trusted documents of that language. Both are taken after PRIOR characters of the language's median loss are added
to a document, as the mean over a few characters says little.

Documents without words have perplexity null and are kept, as are those of a language without held-out trusted text. Null
text counts as empty, null language as a language of its own. Rows that repeat a doc_id with the same text get the same result. Extra columns are ignored. Without
any trusted document all are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_few, give_back, text_or_empty, written

ORDER = 4
START, END = "\x02", "\x03"
#: Bytes of text of a scoring block, and blocks at least.
BLOCK_BYTES, BLOCKS = 16 << 20, 32
#: One of so many trusted documents is held out for the limits.
FOLDS = 5
HIGH = 0.98
#: Characters of median loss that are added to every document before it is held against a limit.
PRIOR = 60
#: Words whose scores are held at once.
SCORED_AT_ONCE = 200_000
#: Distinct words of a language counted before they are turned into n-grams.
WORDS_AT_ONCE = 150_000


def grams(word: str) -> Iterator[str]:
    """For each character of the marked word, the n-gram that ends there; those at the start are shorter."""
    s = START + word + END
    for i in range(1, len(s)):
        yield s[max(0, i + 1 - ORDER) : i + 1]


def count_grams(trusted: DataFrame) -> DataFrame:
    """lang, g, c: occurrences of every n-gram in trusted(lang, text)."""

    def flush(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counted in words.items():
            total: Counter = Counter()
            for word, n in counted.items():
                for g in grams(word):
                    total[g] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "g", "c"])
            counted.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
                if len(words[lang]) > WORDS_AT_ONCE:
                    yield from flush({lang: words[lang]})
        yield from flush(words)

    return trusted.select("lang", "text").mapInArrow(run, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def train(trusted: DataFrame) -> DataFrame:
    """lang, g, logp, bow: log-probability of the last character after the others, and log-weight of g as a context.

    The row g = '' holds the log-probability of a character that was never seen.
    """
    top = written(count_grams(trusted))
    starts = F.col("g").startswith(START)
    tables = {ORDER: top.where(F.length("g") == ORDER)}
    for k in range(ORDER - 1, 0, -1):
        # continuation counts: in how many ways is g preceded
        more = tables[k + 1].groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c"))
        tables[k] = more.unionByName(top.where(starts & (F.length("g") == k)))
    lower = weights = found = None
    for k in range(1, ORDER + 1):
        t = written(tables[k].withColumn("h", F.expr(f"substring(g, 1, {k - 1})")).withColumn("d", F.least("c", F.lit(3))))
        n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]
        y = F.expr("try_divide(n1, n1 + 2 * n2)")
        formula = lambda i: F.coalesce(F.greatest(F.least(F.lit(i) - (i + 1) * y * F.expr(f"try_divide(n{i + 1}, n{i})"), F.lit(float(i))), F.lit(0.0)), F.lit(0.5))
        cuts = t.groupBy("lang").agg(*n).select("lang", *[formula(i).alias(f"d{i}") for i in (1, 2, 3)])  # a row for each language
        context = t.groupBy("lang", "h").agg(F.sum("c").alias("s"), *[F.count_if(F.col("d") == i).alias(f"m{i}") for i in (1, 2, 3)])
        context = context.join(F.broadcast(cuts), "lang")
        context = context.select("lang", "h", "s", ((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("s")).alias("gamma"), "d1", "d2", "d3")
        seen = t.join(context, ["lang", "h"])
        own = (F.col("c") - F.expr("CASE d WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")) / F.col("s")
        if k == 1:
            size = t.groupBy("lang").agg((F.count("*") + 1).alias("v"))
            seen = seen.join(F.broadcast(size), "lang").select("lang", "g", (own + F.col("gamma") / F.col("v")).alias("p"))
            unknown = context.join(F.broadcast(size), "lang").select("lang", F.lit("").alias("g"), (F.col("gamma") / F.col("v")).alias("p"))
            found = seen.unionByName(unknown)
        else:
            below = lower.select("lang", F.col("g").alias("tail"), F.col("p").alias("q"))
            seen = seen.withColumn("tail", F.expr("substring(g, 2)")).join(below, ["lang", "tail"]).select("lang", "g", (own + F.col("gamma") * F.col("q")).alias("p"))
            found = found.unionByName(seen)
            w = context.select("lang", F.col("h").alias("g"), F.col("gamma"))
            weights = w if weights is None else weights.unionByName(w)
        lower = seen = written(seen)
    model = found.join(weights, ["lang", "g"], "full").select("lang", "g", F.log("p").cast("float").alias("logp"), F.log(F.greatest("gamma", F.lit(1e-9))).cast("float").alias("bow"))
    return written(model)


def _packed(docs: DataFrame, blocks: int) -> DataFrame:
    """Documents as compressed record batches of one block each: block, rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch["block"].to_numpy()
            rest = batch.select(["doc_id", "h", "lang", "text"])
            names, out = np.unique(block), []
            for b in names:
                sink = pa.BufferOutputStream()
                part = rest.take(pa.array(np.flatnonzero(block == b)))
                with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["block", "rows"])

    h = F.xxhash64("text")
    rows = docs.select("doc_id", h.alias("h"), "lang", "text", F.pmod(F.xxhash64("doc_id", h), F.lit(blocks)).cast("long").alias("block"))
    return rows.mapInArrow(run, "block long, rows binary")


def _documents(table: pa.Table) -> Iterator[tuple]:
    for rows in table["rows"]:
        for batch in pa.ipc.open_stream(rows.as_py()):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _ask(table: pa.Table) -> pa.Table:
    """The distinct parts, up to ORDER characters, of the marked words of a block."""
    words: dict[str, set] = {}
    for _, _, lang, text in _documents(table):
        words.setdefault(lang, set()).update(text.split())
    langs, parts = [], []
    for lang, some in words.items():
        need: set[str] = set()
        for word in some:
            need.update(grams(word))
        for k in range(ORDER, 1, -1):  # their parts: contexts and shorter n-grams
            need.update([g[1:] for g in need if len(g) == k])
            need.update([g[:-1] for g in need if len(g) == k])
        need.add("")
        langs += [lang] * len(need)
        parts += need
    block = table["block"][0].as_py()
    del words
    give_back()
    return pa.table({"block": pa.array([block] * len(parts), pa.int64()), "lang": pa.array(langs, pa.string()), "g": pa.array(parts, pa.string())})


class _Scores(dict):
    """Word -> log-probability of its characters and end mark."""

    def __init__(self, logp: dict[str, float], bow: dict[str, float]):
        super().__init__()
        self.logp, self.bow, self.unknown = logp, bow, logp.get("", math.log(1e-6))

    def __missing__(self, word: str) -> float:
        s, logp, bow, total = START + word + END, self.logp, self.bow, 0.0
        for i in range(1, len(s)):
            for j in range(max(0, i + 1 - ORDER), i + 1):
                p = logp.get(s[j : i + 1])
                if p is not None:
                    total += p
                    break
                total += bow.get(s[j:i], 0.0)
            else:
                total += self.unknown
        if len(self) >= SCORED_AT_ONCE:
            self.clear()
        self[word] = total
        return total


def _score(table: pa.Table, answers: pa.Table) -> pa.Table:
    by_lang: dict[str, tuple[dict, dict]] = {}
    for lang, g, p, b in zip(*(answers[c].to_pylist() for c in ("lang", "g", "logp", "bow")), strict=True):
        logp, bow = by_lang.setdefault(lang, ({}, {}))
        if p is not None:
            logp[g] = p
        if b is not None and g:
            bow[g] = b
    scores = {lang: _Scores(*x) for lang, x in by_lang.items()}
    out = []
    for doc, h, lang, text in _documents(table):
        words = text.split()
        n = sum(map(len, words)) + len(words)
        mean = sum(map(scores[lang].__getitem__, words)) / n if n and lang in scores else None
        out.append((doc, h, lang, n, None if mean is None else -mean))
    cols = list(zip(*out, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64())
    del by_lang, scores
    give_back()
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "h", "lang", "n", "loss"])


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), lang, n (characters scored), loss (log-perplexity) of docs(doc_id, lang, text)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    packed = _packed(docs, max(BLOCKS, -(-size // BLOCK_BYTES)))
    asked = packed.groupBy("block").applyInArrow(_ask, "block long, lang string, g string")
    answers = asked.join(model, ["lang", "g"]).select("block", "lang", "g", "logp", "bow")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, "doc_id long, h long, lang string, n long, loss double")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h, lang, n_chars, perplexity, limit, kept for every row of docs.

    Trusted are the documents that labels calls good (quality 1) and not toxic.
    """
    own = _own(docs)
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    trusted = own.join(broadcast_if_few(good.where(~held)), "doc_id", "left_semi")
    scored = written(score(own, train(trusted)))
    known = scored.join(broadcast_if_few(good.where(held)), "doc_id", "left_semi").where("loss IS NOT NULL")
    middle = lambda share: F.percentile_approx("loss", F.lit(share), 10_000)
    medians = broadcast_if_few(written(known.groupBy("lang").agg(middle(0.5).alias("m"))))

    def steadied(df: DataFrame) -> DataFrame:
        """The loss as if PRIOR more characters had the median loss: short documents need more to be far off."""
        steady = (F.col("loss") * F.col("n") + PRIOR * F.col("m")) / (F.col("n") + PRIOR)
        return df.join(medians, "lang", "left").withColumn("loss", F.coalesce(steady, F.col("loss")))

    limits = broadcast_if_few(written(steadied(known).groupBy("lang").agg(middle(HIGH).alias("most"))))
    out = steadied(scored).join(limits, "lang", "left")
    kept = ~F.coalesce(F.col("loss") > F.col("most"), F.lit(False))
    return out.select("doc_id", "h", "lang", F.col("n").alias("n_chars"), F.exp("loss").alias("perplexity"), F.exp("most").alias("limit"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that classify() keeps, with their columns."""
    bad = written(classify(docs, labels).where(~F.col("kept")).select("doc_id", "h").distinct())
    docs, bad = docs.alias("docs"), broadcast_if_few(bad).alias("bad")
    same = (F.col("docs.doc_id") == F.col("bad.doc_id")) & (F.xxhash64(text_or_empty("docs.text")) == F.col("bad.h"))
    return docs.join(bad, same, "left_anti")
