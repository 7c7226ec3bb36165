"""Op 3: language by compression with one raw-content dictionary for each language.

A text goes to the language whose dictionary compresses its letters, in lower case, best. Texts are compressed in runs of
4096 bytes, so that the dictionary counts as much at the end of a long text as at its start. The
margin is how much smaller the best result is than the second best; a narrow margin is a rejection.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, table, worker_cache

UNKNOWN = "und"
#: Bounds of the sample that the dictionaries are made of: texts and bytes a language.
SAMPLE_TEXTS, SAMPLE_BYTES = 128, 128 << 10
RUN = 4096
LEVEL = 11
#: A smaller relative margin is a rejection.
MIN_MARGIN = 0.002


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language label, from a bounded sample of its rows.

    The sample: each label's rows are dealt by a hash of their text into SAMPLE_TEXTS bins, and each bin
    gives the text with the least hash, of which SAMPLE_BYTES characters at most count. Their letters follow
    each other in hash order up to SAMPLE_BYTES, which may cut the last one, and no text is fetched after
    those that hold four times as many bytes before it. Copies count once. Rows whose label or text is null,
    or whose text has no letter, are not used. No rows: no languages.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    size = F.least(F.octet_length("text"), F.lit(SAMPLE_BYTES)).cast("long")
    least = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("bin")).agg(F.min(F.struct("h", size.alias("size"))).alias("x"), F.count("*").alias("n"))
    by: dict[str, list] = {}
    for r in least.groupBy("lang").agg(F.sort_array(F.collect_list("x")).alias("xs")).toLocalIterator():  # a row a language
        before = 0
        for x in r.xs:  # SAMPLE_TEXTS at most
            if before < 4 * SAMPLE_BYTES:
                by.setdefault(r.lang, []).append(x.h)
            before += x.size
    if not by:
        return {}
    held = {(lang, h) for lang, hs in by.items() for h in hs}
    wanted = labelled.sparkSession.createDataFrame(sorted(held), "lang string, h long")  # SAMPLE_TEXTS a language at most
    found = rows.join(F.broadcast(wanted), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min(F.substring("text", 1, SAMPLE_BYTES)).alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in found.toLocalIterator():
        if (r.lang, r.h) in held:
            texts.setdefault(r.lang, []).append((r.h, r.text))
    made = {lang: b"".join(letters(t + "\n") for _, t in sorted(some))[:SAMPLE_BYTES] for lang, some in sorted(texts.items())}
    return without_shared(made)


def without_shared(samples: dict[str, bytes], n: int = 3) -> dict[str, bytes]:
    """The samples without the words of those n-word sequences that more than one language's sample has.

    Quotations and notices that go round in every language would otherwise pull texts to whichever sample
    happens to hold them.
    """
    words = {lang: raw.split() for lang, raw in samples.items()}
    grams = {lang: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for lang, w in words.items()}
    seen = Counter(g for own in grams.values() for g in own)
    made = {}
    for lang, w in words.items():
        shared = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                shared[i : i + n] = [True] * n
        made[lang] = b" ".join(x for x, s in zip(w, shared, strict=True) if not s)
    return made


def _mark_ranges() -> list[tuple[int, int]]:
    """First and last code points of the runs of combining marks (general categories Mn, Mc and Me)."""
    runs: list[list[int]] = []
    for c in range(0x300, 0xE01F0):
        if unicodedata.category(chr(c))[0] == "M":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return [(a, b) for a, b in runs]


_RANGES = "".join(f"{chr(a)}-{chr(b)}" for a, b in _mark_ranges())
_OTHER = re.compile(r"[\W\d_]+")
#: All marks lie beyond this.
_FAR = re.compile("[^\\x00-\u02ff]")
#: Combining marks aren't word characters to `re`, but vowels and tones of many scripts.
_OTHER_BUT_MARKS = re.compile(rf"(?:[^\w{_RANGES}]|[\d_])+")


def letters(text: str) -> bytes:
    """The text in lower case with a space for each run of anything but letters and their marks: case, markup and numbers don't tell languages apart."""
    low = text.lower()
    other = _OTHER if low.isascii() or not _FAR.search(low) else _OTHER_BUT_MARKS  # the same result, the first one faster
    return other.sub(" ", low).encode("utf-8", "surrogatepass")


class Compressors:
    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...]):
        import zstandard as z

        self.langs = [lang for lang, _ in dictionaries]

        def compressor(raw: bytes):
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        self.compress = [compressor(raw) for _, raw in dictionaries]

    def sizes(self, text: str) -> list[int]:
        raw = letters(text)
        runs = [raw[i : i + RUN] for i in range(0, len(raw), RUN)]
        return [sum(len(c(r)) for r in runs) for c in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, margin from 0 to 1, and whether it is accepted."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)  # ties: the first label in order
        if len(sizes) == 1:
            return self.langs[0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.langs[best], margin, margin >= MIN_MARGIN


@worker_cache
def compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> Compressors:
    return Compressors(dictionaries)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1, rising with the margin), margin and accepted.

    lang_pred is `und`, never accepted, if the text is null or has no letter, or if nothing was learned.
    Columns of docs with these names are replaced.
    """
    new = ["lang_pred", "score", "margin", "accepted"]
    docs = docs.drop(*new)
    held = tuple(sorted(dictionaries.items()))
    at = docs.columns.index(text_col)
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, new, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = compressors(held)
        for batch in batches:
            got = [c.predict(t) for t in batch.column(at).to_pylist()]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] / (g[1] + 0.02) for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    learned = fit(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return classify(rows, learned).drop("text")
