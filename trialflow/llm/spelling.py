"""Spelling variants: words one edit apart, found by dense comparisons of code-point matrices.

Two words are one insertion, deletion or replacement apart just if their common prefix and common
suffix together reach the longer length minus one. Such a pair also agrees on the first half of the
shorter word or on its rest, so words are dealt into groups by either; a large group is cut into
blocks by hash, and every pair of its blocks is one tile, compared at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.session import stage

#: A run of letters: ASCII and the second half of Latin-1.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words of fewer code points, or that occur less often, are left out.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs so many times as often as its variant at least.
RATIO = 5
#: Of runs whose hash this number divides, one letter is dropped (see ``slipped``).
SLIP = 199
#: Words whose tiles one task compares, about.
TASK_WORDS = 10_000
#: Words of a block at most on average, and numbers in its matrix.
BLOCK, BLOCK_NUMBERS = 512, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(run: Column, doc_id: Column, every: int) -> Column:
    """``run`` without its code point h mod length if ``every`` divides h = crc32("<doc_id>:<run>").

    A run of a row without id is left as it is.
    """
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    slip: int | None = None,
) -> DataFrame:
    """(word, n) of all runs of letters of the whole texts, A-Z lower-cased, with occurrences.

    Counts combine before the shuffle, so a frequent word is one row per task.
    """
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    # Only a run one longer than a word may lose a letter and still be one.
    runs = runs.filter(F.char_length("run") >= min_length)
    word = slipped(F.col("run"), F.col("id"), slip) if slip else F.col("run")
    counted = runs.select(word.alias("word")).filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def tiles(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``words`` (word, n) dealt into tiles: (m, half, key, i, j, own, word, n).

    A group (m, half, key) holds words of m or m + 1 code points that agree on their first m div 2
    (half 0) or last m - m div 2 code points (half 1). Its n words make ceil(n / size) blocks, and a
    word of block b is sent to the tiles (i, j) with i = b or j = b.
    """
    size = F.char_length("word")

    def keyed(m: Column) -> Column:
        first = F.floor(m / 2).cast("int")
        halves = [F.substring("word", F.lit(1), first), F.substring(F.col("word"), size - (m - first) + 1, m - first)]
        return [F.struct(m.alias("m"), F.lit(k).alias("half"), F.xxhash64(h).alias("key")) for k, h in enumerate(halves)]

    dealt = words.select("word", "n", F.inline(F.array(*keyed(size), *keyed(size - 1)))).filter("m > 0")
    group = ["m", "half", "key"]
    short = F.col("m") == size
    sizes = dealt.groupBy(*group).agg(F.count("*").alias("members"), F.count_if(short).alias("short"))
    own_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_NUMBERS) / (F.col("m") + 1))))
    blocks = sizes.filter("members > 1 AND short > 0").select(*group, F.ceil(F.col("members") / own_block).cast("int").alias("blocks"))
    placed = dealt.join(blocks, group).withColumn("own", F.pmod(F.xxhash64(F.lit(1), "word"), "blocks").cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


def code_points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, left-aligned, right-aligned): code points of each word, padded with zeros."""
    sizes = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left[row, at] = flat
    right[row, at + width - sizes[row]] = flat
    return sizes, left, right


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns each row of ``a`` shares with each row of ``b``."""
    on = np.ones((len(a), len(b)), bool)
    total = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        on &= a[:, k, None] == b[None, :, k]
        if not on.any():
            break
        total += on
    return total


def near_in_tile(first: list[str], second: list[str] | None, m: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``first``, in ``second``) of words one edit apart; ``second`` None stands for ``first``, each pair once.

    The shorter of a pair has m code points, the longer m or m + 1. A pair that agrees on both halves
    is only given by half 0.
    """
    n, left, right = code_points(first, m + 1)
    n2, left2, right2 = (n, left, right) if second is None else code_points(second, m + 1)
    prefix, suffix = _agreeing(left, left2), _agreeing(right[:, ::-1], right2[:, ::-1])
    near = prefix + suffix >= np.maximum(n[:, None], n2[None, :]) - 1
    near &= (n[:, None] == m) | (n2[None, :] == m)
    near &= (prefix >= m // 2) if half == 0 else (prefix < m // 2)
    if second is None:
        near = np.triu(near, 1)
    return np.nonzero(near)


def near_words(dealt: DataFrame, n_tasks: int) -> DataFrame:
    """(word, n_near, best): in parts, how many words are one edit away, and the most frequent of them as (-n, word)."""
    key = ["m", "half", "key", "i", "j"]
    sent = dealt.repartition(max(1, n_tasks), *key).sortWithinPartitions(*key, "word")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def finish() -> pa.RecordBatch | None:
            m, half, _, i, j = last
            own = np.concatenate([h[0] for h in held])
            words, n = np.array([w for h in held for w in h[1]], object), np.concatenate([h[2] for h in held])
            one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if len(one) == 0 or len(two) == 0:
                return None
            x, y = near_in_tile(words[one].tolist(), None if i == j else words[two].tolist(), m, half)
            if len(x) == 0:
                return None
            x, y = np.concatenate((one[x], two[y])), np.concatenate((two[y], one[x]))
            order = np.lexsort((y, -n[y], x))
            x, y = x[order], y[order]
            starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            best = pa.StructArray.from_arrays([pa.array(-n[y[starts]]), pa.array(words[y[starts]].tolist(), pa.string())], ["less", "word"])
            return pa.RecordBatch.from_arrays([pa.array(words[x[starts]].tolist(), pa.string()), pa.array(np.diff(np.append(starts, len(x)))), best], ["word", "n_near", "best"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in key]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else []
            own, words, n = batch.column("own").to_numpy(), batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = tuple(int(c[a]) for c in columns)
                if last is not None and now != last:
                    if (out := finish()) is not None:
                        yield out
                    held = []
                last = now
                held.append((own[a:b], words[a:b], n[a:b]))
        if last is not None and (out := finish()) is not None:
            yield out

    return sent.mapInArrow(compare, "word string, n_near long, best struct<less: long, word: string>")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, the word itself if it has none.

    A form occurs RATIO times as often as its word, so chains end; each round doubles the steps taken.
    """
    chain = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        step = chain.filter("word <> root").select(F.col("word").alias("root"), F.col("root").alias("__up"))
        further = stage(chain.join(step, "root", "left").select("word", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved")), "spelling-roots")
        if further.filter("moved").isEmpty():
            return further.select("word", "root")
        chain = further.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    n_near counts the words one edit away. The form is the most frequent of them (of equals the first
    in code-point order) if it occurs ``ratio`` times as often as the word; root is the end of the
    chain of forms. Words must be distinct and not NULL; a word of any length is compared whole; an
    empty table gives an empty result; other columns are not read, so their names cannot clash.
    """
    if ratio < 2:
        raise ValueError("chains of forms end only if a form is more frequent than its word")
    words = stage(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = near_words(tiles(words, block), -(-words.count() // TASK_WORDS)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    found = stage(
        words.join(near, "word", "left").select(
            "word", F.when(common, F.col("best.word")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None) -> DataFrame:
    """``variant_groups`` of the words of all texts (see ``count_words``).

    NULL, empty and letterless texts have no words; repeated rows count each time; ``slip`` drops a
    letter of one run in so many (rows without id: of none).
    """
    return variant_groups(count_words(docs, id_col, text_col, slip=slip))
