"""Language identification by compression.

Each language has a zstandard raw-content dictionary: text of that language. A text is cut into blocks (all of it is
read), each block is compressed once with each dictionary, and the language whose dictionary makes the sum of sizes
least is chosen. Where the runner-up's code is not longer by more than ``margin`` of the best code's length, the choice
is rejected as too narrow. The margin is set on training texts that are in no dictionary: ``MARGIN_PART`` of the lead
that all but ``NARROW_SHARE`` of those rightly told have.

Dictionaries and margin are fitted on a bounded sample: for each language, the first ``sample_docs`` training documents
by a hash for the dictionaries, pieces from all over the text and an equal share of the dictionary each, and as many
again for the margin. Dictionaries are the only thing that is sent to the executors: ``dict_bytes`` for each of at most
``MAX_LANGUAGES`` languages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.llm.common import fresh, trim
from docflow.llm.words import slices

MAX_LANGUAGES = 256
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Share of rightly told training texts whose lead counts as narrow, and the part of that lead that is the margin.
NARROW_SHARE, MARGIN_PART = 0.005, 0.5
#: Pieces of a training text, evenly spread.
PIECES = 4
#: First groups of the sample: a language's rows meet by it before they meet as a whole.
SAMPLE_SALTS = 256
#: The text is compressed in blocks so that the dictionary counts throughout, not just where a long text begins.
BLOCK_BYTES = 4096
#: Short texts follow run-ups, pieces of the language's own dictionary; alone they are too short to be compressed. What
#: counts is how much longer they make the run-ups' code.
SHORT_BYTES, RUN_UP_BYTES, RUN_UPS = 200, 60, 4
#: A search for all matches of three bytes and more; the presets for speed overlook the short ones that tell languages apart.
SEARCH = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 4, "min_match": 3, "target_length": 16, "strategy": zstandard.STRATEGY_GREEDY}


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[tuple[str, bytes], ...]
    margin: float  # of the best code's length


def pieces(text: Column, chars: int) -> Column:
    """All of a text of ``chars`` characters, or that much of it in pieces from all over."""
    size = chars // PIECES
    places = [F.floor((F.length(text) - size) * (k / (PIECES - 1))).cast("int") + 1 for k in range(PIECES)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *(F.substring(text, at, F.lit(size)) for at in places)))


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, sample_docs: int = 256, sample_chars: int = 2000, dict_bytes: int = 16_384) -> Model:
    """The model of rows with a language and a text that has a letter; others are passed over.

    The samples are the first texts of each language by a hash of ``key`` and text (ties: equal texts). They are chosen
    within each input partition, then in salted groups, then as a whole. No rows, no languages.
    """
    text = F.col(text_col)
    rows = train.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), pieces(text, sample_chars).alias("text"), F.xxhash64(text if key is None else key, text).alias("h"))
    for by in (["lang", "salt"], ["lang"]):
        first = W.partitionBy(*by).orderBy("h", "text")
        rows = rows.withColumn("salt", F.spark_partition_id() % SAMPLE_SALTS).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= 2 * sample_docs)
    texts: dict[str, dict[str, str]] = {}
    for r in rows.orderBy("lang", "nth").collect():
        texts.setdefault(r["lang"], {})[prepared(r["text"])] = r["text"]
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"{len(texts)} languages; the dictionaries are broadcast for at most {MAX_LANGUAGES}")
    dictionaries, others = [], []
    for lang, found in sorted(texts.items()):
        chosen = list(found)[: max(1, min(sample_docs, len(found) // 2))]
        dictionaries.append((lang, dictionary(chosen, dict_bytes)))
        others += [(lang, found[x]) for x in list(found)[len(chosen) :]]
    model = tuple(dictionaries)
    return Model(model, margin_of(model, others))


def dictionary(texts: list[str], size: int) -> bytes:
    """An equal share of each text, from a place that its own checksum gives; what short texts leave goes to the others."""
    out, left = [], size
    for k, text in enumerate(sorted(texts, key=len)):
        share = max(1, left // (len(texts) - k))
        data = text.encode()
        at = zlib.crc32(data) % (len(data) - share + 1) if len(data) > share else 0
        out.append(data[at : at + share - 1] + b"\n")
        left -= len(out[-1])
    return b"".join(out)[:size]


def margin_of(dictionaries: tuple[tuple[str, bytes], ...], texts: list[tuple[str, str]]) -> float:
    """The margin that ``texts`` (language, text) set."""
    leads = []
    for lang, text in texts:
        sizes = code_lengths(text, dictionaries)
        best, lead = best_of(sizes)
        if dictionaries[best][0] == lang:
            leads.append(lead)
    leads.sort()
    return MARGIN_PART * leads[int(NARROW_SHARE * len(leads))] if leads and len(dictionaries) > 1 else 0.0


def prepared(text: str) -> str:
    """Lower case, and one space for each run of anything but letters and marks: what tells languages apart."""
    return " ".join(regex.findall(r"[\p{L}\p{M}']+", text.lower()))


@lru_cache(maxsize=2)
def compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[zstandard.ZstdCompressor, list[bytes], int]]:
    """The compressor of each language, its run-ups and the length of their codes; one list per worker."""
    params = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
    out = []
    for _, content in dictionaries:
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        run_ups = [content[i : i + RUN_UP_BYTES] + b" " for i in range(0, len(content), len(content) // RUN_UPS + 1)]
        out.append((c, run_ups, sum(len(c.compress(x)) for x in run_ups)))
    return out


def code_lengths(text: str, dictionaries: tuple[tuple[str, bytes], ...]) -> list[int]:
    """Bytes of the text's blocks, compressed with each dictionary."""
    data = prepared(text).encode()
    if len(data) < SHORT_BYTES:
        return [sum(len(c.compress(x + data)) for x in run_ups) - alone for c, run_ups, alone in compressors(dictionaries)]
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c, *_ in compressors(dictionaries)]


def best_of(sizes: list[int]) -> tuple[int, float]:
    """The place of the least code length (the first of equal ones), and by which part of it the next is longer."""
    best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
    lead = min((s for i, s in enumerate(sizes) if i != best), default=2 * max(1, sizes[best])) - sizes[best]
    return best, lead / max(1, sizes[best])


def classify(text: str | None, model: Model) -> tuple[str, float, bool]:
    if not model.dictionaries or not text or not LETTER.search(text):
        return UNKNOWN, 0.0, True
    sizes = code_lengths(text, model.dictionaries)
    best, lead = best_of(sizes)
    # a byte less is worth a factor of two: the posterior of the code lengths, tempered
    score = 1 / sum(2.0 ** max(-1000, sizes[best] - s) for s in sizes)
    return model.dictionaries[best][0], score, lead <= model.margin


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row.

    * lang_pred is ``und``, score 0 and rejected true where the text is null, empty or has no letter, or no language is
      known. Very long texts are read whole, in blocks.
    * Ties go to the first language by name and are rejected, like all choices with a lead of the margin or less.
    * Repeated rows get a row each. No rows in, no rows out. Only the two columns named are read, whatever others there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [classify(x.as_py(), model) for x in b.column(1)]
            made = [pa.array([x[k] for x in found], type=t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that identify doesn't reject, with all their columns, whatever their names. Null, empty and
    odd texts, ties, repeated rows and empty tables are as there."""
    names, n = [c.lower() for c in df.columns], len(df.columns)
    if names.count(text_col.lower()) == 1:  # texts are sent once
        rows, at = df, names.index(text_col.lower())
    else:  # a field of a column, or one whose name the session tells from another by case
        (name,) = fresh(df, "text_in")
        rows, at = df.withColumn(name, F.col(text_col)), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, at):
                keep = [not classify(x.as_py(), model)[2] for x in b.column(at)]
                yield b.select(range(n)).filter(pa.array(keep, pa.bool_()))
        compressors.cache_clear()
        trim()

    return rows.mapInArrow(run, df.schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3. Null ids: not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_training_rows(docs: DataFrame) -> Model:
    return fit(docs.where(~is_held_out() & F.col("doc_id").isNotNull()), key=F.col("doc_id"))
