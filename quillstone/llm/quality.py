"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.shared import fingerprint, keep, sized

SYMBOLS = K.byte_class([(ord(c), ord(c)) for c in "#*$%&|<>"])
UPPER = K.byte_class([(0x41, 0x5A)])
#: Cutoffs are multiples of this, in thousandths, up to so many.
STEP, STEPS = 25, 40


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where the same key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), dtype=bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:].copy()
    out = np.empty_like(same)
    out[order] = same
    return out


def _earlier(keys: np.ndarray) -> np.ndarray:
    """True where the same key occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(s), dtype=bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts over each whole text: id_col, fp (xxhash64 of the text), stratum, n_words, word_chars, n_symbols, n_lines
    (with a word), n_dup_lines, n_repeat_words, n_upper. Row by row, nothing is shuffled; null text has no words, null
    stratum is ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, last_row, raw, offsets in K.blocks(batch.column(3)):
                m = last_row - first_row
                starts, ends, first = K.spans(raw, offsets, K.SPACE)
                owner = K.owners(first)

                def each(flags: np.ndarray, offsets=offsets) -> np.ndarray:
                    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
                    return sums[offsets[1:]] - sums[offsets[:-1]]

                salt = K.mix(owner.astype(np.uint64))
                triples = K.sequences(K.span_hashes(raw, starts, ends), 3)
                whole = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
                at = np.flatnonzero(whole)
                at = at[_repeated(triples[at] ^ salt[at])]
                repeat = np.zeros(len(starts), dtype=bool)
                for j in range(3):
                    repeat[at + j] = True

                line_break = np.zeros(len(raw) + 1, dtype=bool)
                line_break[:-1] = raw == 0x0A
                edges = np.zeros(len(raw) + 1, dtype=bool)
                edges[offsets[:-1]] = True
                edges[1:] |= line_break[:-1]
                edges[-1] = False
                low = np.flatnonzero(edges)
                high = np.append(low[1:], len(raw))
                high = np.where(line_break[high - 1] & (high > low), high - 1, high)
                words_before = np.searchsorted(starts, low)
                with_word = np.searchsorted(starts, high) > words_before
                low, high = low[with_word], high[with_word]
                line_owner = np.searchsorted(offsets, low, "right") - 1
                dup = _earlier(K.span_hashes(raw, low, high) ^ K.mix(line_owner.astype(np.uint64)))

                n_words = np.diff(first)
                columns = [n_words, each((raw & 0xC0) != 0x80) - each(K.SPACE[raw]), each(SYMBOLS[raw]), np.bincount(line_owner, minlength=m), np.bincount(line_owner[dup], minlength=m), np.bincount(owner[repeat], minlength=m), each(UPPER[raw])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first_row, m) for k in range(3)), *(pa.array(c.astype(np.int64)) for c in columns)], ["id", "fp", "stratum", *NAMES])

    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), fingerprint(text_col).alias("fp"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(count, f"id {id_type}, fp long, stratum string, {', '.join(f'{n} long' for n in NAMES)}").withColumnRenamed("id", id_col)


NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def score() -> Column:
    """The largest of four shares, in thousandths: symbols and repeated words by words, capitals by letters, repeated lines by lines."""
    share = [F.expr(f"coalesce(1000 * {a} div nullif({b}, 0), 0)") for a, b in (("n_symbols", "n_words"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_dup_lines", "n_lines"))]
    return F.greatest(*share)


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X of a binomial distribution, summed in logarithms; 1 without summing where k is over n * p."""
    lp, lq = f"ln({p}D)", f"ln(1 - {p}D)"
    return F.expr(
        f"CASE WHEN {k} > {n} * {p} THEN 1D WHEN {k} = 0 THEN exp({n} * {lq}) ELSE aggregate(sequence(1, {k}), "
        f"named_struct('t', {n} * {lq}, 's', exp({n} * {lq})), "
        f"(a, i) -> named_struct('t', a.t + ln(({n} - i + 1D) / i) + {lp} - {lq}, 's', a.s + exp(a.t + ln(({n} - i + 1D) / i) + {lp} - {lq})), a -> a.s) END"
    )


def cutoffs(scored: DataFrame, labels: DataFrame, most_rejected: float = 0.01, error: float = 0.05, id_col: str = "doc_id") -> DataFrame:
    """A cutoff for each stratum that has one: stratum, cutoff, n_good, n_rejected.

    A cutoff passes if the labelled good documents it rejects are so few that, were the true share of
    rejected good documents over ``most_rejected``, so few would occur with probability ``error`` / m at
    most (the exact binomial bound), m being the number of strata. In each stratum cutoffs are tried from the
    most lenient one on, up to the first that doesn't pass: a fixed sequence needs no further
    correction, so with probability 1 - ``error`` every cutoff that passes, in any stratum, rejects at
    most that share of its stratum's good documents. At 1 %, 5 % and four strata this takes 436 good labels in
    a stratum. Of the cutoffs that pass, the most lenient is chosen whose catch of labelled bad
    documents is within a hundredth of the best catch; a stratum without one rejects nothing. Scores
    are fixed beforehand, so all labels are holdout. Documents with several rows count once for each different text.
    """
    known = labels.where("quality IS NOT NULL").groupBy(id_col).agg(F.min("quality").alias("quality"))
    places = scored.join(known, id_col).groupBy("stratum", F.expr(f"least(cast(ceil(score / {STEP}D) AS int), {STEPS + 1})").alias("place")).agg(F.expr("count_if(quality = 1)").alias("good"), F.expr("count_if(quality = 0)").alias("bad"))
    places = keep(places)  # at most STEPS + 2 rows for each stratum
    grid = places.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(STEPS + 1))).alias("place"))
    lenient = Window.partitionBy("stratum").orderBy(F.desc("place"))
    beyond, upto = lenient.rowsBetween(Window.unboundedPreceding, -1), lenient.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("stratum")
    table = grid.join(places, ["stratum", "place"], "left").select("stratum", "place", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "bad")))
    table = table.select("stratum", "place", *(F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"{c}_out") for c in ("good", "bad")), F.sum("good").over(all_).alias("n_good")).where(F.col("place") <= STEPS)
    strata = places.agg(F.countDistinct("stratum").alias("strata"))
    table = table.crossJoin(F.broadcast(strata)).withColumn("chance", binomial_cdf("good_out", "n_good", most_rejected))  # one row
    sure = table.withColumn("passed", F.bool_and(F.col("chance") <= error / F.col("strata")).over(upto)).where("passed")
    best = sure.withColumn("best", F.max("bad_out").over(all_)).where("bad_out > 0 AND bad_out >= 0.99D * best")
    return best.groupBy("stratum").agg((F.max("place") * STEP).alias("cutoff"), F.max_by(F.col("n_good"), "place").alias("n_good"), F.max_by("good_out", "place").alias("n_rejected"))


def quality(docs: DataFrame, labels: DataFrame, most_rejected: float = 0.01, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Judges every row of docs: id_col, fp (xxhash64 of the text), stratum, the counts of features(), score, cutoff,
    base_failed, kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept:
    not base_failed, and the score is not over the stratum's cutoff (null: none is certified). Null
    text fails the base rule; null strata are one stratum ''; a document with several labels counts
    by the lowest; labels of other documents and null labels are ignored; without labels nothing
    but the base rule rejects. Repeated rows are judged alike, rows of one id with other texts by their own text; other
    columns are not read.
    """
    scored = keep(features(docs, id_col, text_col, stratum_col).withColumn("score", score()))
    chosen = keep(cutoffs(scored.dropDuplicates([id_col, "fp", "stratum"]), labels, most_rejected, error, id_col)).select("stratum", "cutoff")
    out = scored.join(sized(chosen), "stratum", "left")
    out = out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", F.expr("NOT base_failed AND NOT coalesce(score > cutoff, false)"))
