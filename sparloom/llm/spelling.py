"""Spelling variants of words by asymmetric q-chunks.

Two words are near if they differ by one inserted, deleted or replaced code point. Of two words, the shorter (or
either, if they are as long) is cut into two disjoint chunks and the other gives its grams of a chunk's size: one
edit leaves one of the chunks whole, and the other word has it at the same place or one further. Only grams at
places that are within this shift of a chunk's start can meet one, so only these are given: of a word as long, at
the same place; of a word longer by one, the first chunk at its place and the second one further.

What is left of both words beside the shared chunk holds the edit. A bucket of a chunk that is too crowded to
compare its words is cut again: what is left is cut into two chunks, one of which both words share, and so on,
down to a single code point, where a bucket has no more words than there are letters. So no bucket gives all its
pairs unless they are few, no pair is missed, and all that meet are verified.

Words are counted in Spark, a block of text at a time, summed up before the shuffle; chunks, joins and forms are
DataFrame operations.

Defined results: null and empty texts have no words; a null id is read as an empty text before the colon of the
hash; repeated rows count as often as they stand; a word of any length is taken whole; other columns are left
out; no rows give no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import materialize

#: Code points and occurrences of a word, at least.
MIN_CHARS, MIN_COUNT = 7, 2
#: How many times as frequent a form is as its variant, at least.
TIMES = 10
#: Of a run of which hash a code point goes: every such multiple.
DAMAGED = 31
#: Pairs that a bucket may compare.
CROWDED = 2_000
#: Code points up to which a table of distances is filled; beyond, the common beginning tells.
TABLE = 256
#: Characters of a text that are read at a time, and words that a task counts before it hands them on.
BLOCK, HELD = 1 << 20, 500_000
LOWER = {c: c + 32 for c in range(65, 91)}
LETTER = "A-Za-zÀ-ÿ"


def _runs(text: str, at_least: int) -> Counter[str]:
    """Lower-cased maximal runs of letters of at least so many code points, with their numbers."""
    run, letter, found, at = re.compile(f"[{LETTER}]{{{at_least},}}"), re.compile(f"[^{LETTER}]"), Counter(), 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):  # a block ends at a character that is no letter
            stop = letter.search(text, end)
            end = stop.start() if stop else len(text)
        for word, n in Counter(run.findall(text[at:end])).items():
            found[word.translate(LOWER)] += n
        at = end
    return found


def damaged(doc_id: object, run: str, every: int = DAMAGED) -> str:
    """The run without one code point, for one in ``every`` of all pairs of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], min_chars: int, every: int | None) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            i = doc_id.as_py()
            for run, n in _runs(text.as_py() or "", min_chars).items():
                word = run if every is None else damaged(i, run, every)
                if len(word) >= min_chars:
                    held[word] += n
            if len(held) >= HELD:
                yield told()
    if held:
        yield told()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int | None = DAMAGED) -> DataFrame:
    """(word, n) of all words of so many code points and occurrences; ``every``: see damaged, None for whole runs."""
    own = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = own.mapInArrow(lambda it: _counted(it, min_chars, every), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _cut(rows: DataFrame) -> DataFrame:
    """Both halves of what is still open of each row (word, n, size, longer, a, b): places a to b of a word of
    ``size`` code points; a word longer by one is open a place further."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), middle.alias("b")))
    return rows.select("word", "n", "size", "longer", F.inline(halves))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of a row: all of the word that is not open, and where."""
    shared = F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("|"), F.substring("word", F.col("b") + F.col("longer") + 1, F.length("word")))
    return rows.withColumn("key", F.concat_ws(",", "size", "a", "b", shared))


def _one_edit(x: Column, y: Column) -> Column:
    """Whether a replaced or an inserted code point makes y of x, which is no longer than y."""
    step = lambda p, k: F.when(F.substring(x, p + 1, k) == F.substring(y, p + 1, k), p + k).otherwise(p)
    powers = F.transform(F.sequence(F.floor(F.log2(F.length(x))).cast("int"), F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int"))
    common = F.aggregate(powers, F.lit(0), lambda p, k: F.when(p + k <= F.length(x), step(p, k)).otherwise(p))
    same = lambda p: F.substring(y, p + 2, F.length(y)) == F.substring(x, p + 2 - (F.length(y) - F.length(x)), F.length(x))
    return F.when(F.length(x) <= TABLE, F.levenshtein(x, y, 1) == 1).otherwise(same(common) & (x != y))


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(x, x_n, y, y_n): every pair of near words of (word, n), once; x is the shorter, or the smaller of two of
    equal length."""
    both = F.array(*[F.struct((F.length("word") - k).alias("size"), F.lit(k).alias("longer")) for k in (0, 1)])
    rows = words.select("word", "n", F.inline(both)).filter("size > 0").select("word", "n", "size", "longer", F.lit(0).alias("a"), F.col("size").alias("b"))
    found, level = [], 0
    while True:
        keyed = materialize(_keyed(_cut(rows) if level else _cut(rows.filter("size > 1")).unionByName(rows.filter("size = 1"))), "spelling-chunks")
        met = keyed.groupBy("key").agg(F.count_if(F.col("longer") == 0).alias("short"), F.count_if(F.col("longer") == 1).alias("long"))
        # as many pairs as a bucket gives; without a shorter word, none
        met = met.withColumn("pairs", F.col("short") * (F.col("short") - 1) / 2 + F.col("short") * F.col("long")).filter("pairs > 0")
        told = materialize(keyed.join(met.select("key", "pairs"), "key"), "spelling-buckets")
        small = (F.col("pairs") <= crowded) | (F.col("b") - F.col("a") <= 1)
        now = told.filter(small)
        x = now.filter("longer = 0").select("key", F.col("word").alias("x"), F.col("n").alias("x_n"))
        y = now.select("key", "longer", F.col("word").alias("y"), F.col("n").alias("y_n"))
        met = x.join(y, "key").filter((F.col("longer") == 1) | (F.col("x") < F.col("y"))).filter(_one_edit(F.col("x"), F.col("y")))
        found.append(materialize(met.select("x", "x_n", "y", "y_n"), "spelling-pairs"))
        rows, level = told.filter(~small).select("word", "n", "size", "longer", "a", "b"), level + 1
        if not rows.limit(1).count():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    return pairs.distinct()  # an insertion into a run of equal letters leaves both chunks


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the rows of ``word_counts``: the number of near words; the near
    word of largest n, ties to the smallest, if it is ``times`` as frequent; and the last word that forms lead to.
    A form is so much more frequent than its variant that there are few steps to the last."""
    words = materialize(words.select("word", "n"), "spelling-words")
    pairs = near_words(words)
    sides = pairs.select(F.inline(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n")), F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("x_n").alias("other_n")))))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), "other")).alias("best"))
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.order")).alias("other_n"))
    is_form = F.col("other_n") >= times * F.col("n")
    told = materialize(told.select("word", "n", "n_near", F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n")), "spelling-forms")
    led = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a root is away
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = materialize(led.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not led.filter("moved").limit(1).count():
            break
        led = led.select("word", "root")
    return told.join(led.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int | None = None) -> DataFrame:
    """Forms of all words of the texts as they are, or damaged."""
    return forms(word_counts(docs, id_col, text_col, min_chars, min_count, every))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    found = spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=DAMAGED)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


#: Near words share what is left of them with one code point out, at the same place or next to it.
OP12_SQL = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY doc_id, run),
hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
bytes AS (SELECT doc_id, run, n, list_transform(range(0, length(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) AS b FROM hexed),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b::BIGINT[]), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) AS h FROM bytes),
told AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM told WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
out AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM out a JOIN out b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT o.word, w.word, w.n FROM out o JOIN words w ON o.rest = w.word
    UNION SELECT w.word, o.word, o.n FROM out o JOIN words w ON o.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
led AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT l.word, f.form, l.steps + 1 FROM led l JOIN formed f ON f.word = l.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM led GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word"""
