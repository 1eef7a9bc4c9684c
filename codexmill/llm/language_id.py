"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with counts
frozen after training. A byte's code length in a language comes from the longest
context that the language has seen with it; each longer context it knows costs
an escape (method C: symbols seen / (count + symbols seen)). The language with
the shortest code for the whole text wins, and the score is its share of the
posterior under equal priors.

With frozen counts a byte's code length depends on its last bytes alone. So all
languages' values are precomputed for every gram that any language has seen, as
one row of a matrix, and documents are scored by array look-ups in Arrow batches.

Training uses a bounded sample: at most ``train_chars`` characters a language and
``TRAIN_CHARS`` in all, whole documents drawn by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_contexts import Index, counted, grams
from .common import in_worker

#: Bytes of context at most.
ORDER = 4
#: Bound of the training sample over all languages, in characters.
TRAIN_CHARS = 24_000_000
#: Bytes scored at once, and cells of the score matrix.
CHUNK_BYTES, CHUNK_CELLS = 1 << 20, 1 << 23

LETTER = regex.compile(r"\p{L}")


def prepared(text: str) -> bytes:
    """Lower-cased bytes after a start context."""
    return b"\n" * ORDER + text.lower().encode()


class Model:
    """Values of all languages for the grams of any of them.

    By order j: ``value[j]``, log probability rows of grams of j context bytes and
    one more; ``escape[j]``, log escape probability rows of contexts (0 in languages
    that haven't seen the context, for they start lower).
    """

    def __init__(self, languages: list[str], keys: np.ndarray, language: np.ndarray, counts: np.ndarray):
        self.languages, n = languages, len(languages)
        self.gram_index, self.value, self.context_index, self.escape = [], [], [], []
        lower_keys = lower = None
        for order in range(ORDER + 1):
            own = keys & np.uint64((1 << 8 * (order + 1)) - 1)
            union, row = np.unique(own, return_inverse=True)
            count = np.zeros((len(union), n))
            np.add.at(count, (row, language), counts)
            contexts, context = np.unique(union >> np.uint64(8), return_inverse=True)
            total, symbols = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, context, count)
            np.add.at(symbols, context, (count > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log(symbols / (total + symbols)), 0.0)
                seen = np.log(count / (total + symbols)[context])
            if order:
                below = lower[np.searchsorted(lower_keys, union & np.uint64((1 << 8 * order) - 1))]
            else:
                below = np.full((len(union), n), -np.log(256))
            value = np.where(count > 0, seen, escape[context] + below)
            lower_keys, lower = union, value
            self.gram_index.append(Index(union))
            self.value.append(value.astype(np.float32))
            self.context_index.append(Index(contexts))
            self.escape.append(escape.astype(np.float32))

    def log_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """A row of totals a text (as ``prepared``), a column a language."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        size, most = 0, max(1, min(CHUNK_BYTES, CHUNK_CELLS // max(1, len(self.languages))))
        for i, text in enumerate(texts):
            if size and size + len(text) > most:
                self._add(out, group, [texts[g] for g in group])
                group, size = [], 0
            if len(text) > most:  # a long text in parts that overlap by the context
                for at in range(ORDER, len(text), most):
                    self._add(out, [i], [text[at - ORDER : at + most]])
                continue
            group.append(i)
            size += len(text)
        if group:
            self._add(out, group, [texts[g] for g in group])
        return out

    def _add(self, out: np.ndarray, rows: list[int], texts: list[bytes]) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        every = grams(np.frombuffer(b"".join(texts), np.uint8), ORDER + 1)
        # Positions whose gram crosses into the next text are of its start context.
        ends = np.cumsum(lengths)
        use = np.ones(ends[-1], bool)
        for k in range(ORDER):
            use[ends - lengths + k] = False
        keys = every[use[ORDER:]]
        if not len(keys):
            return
        at = self.gram_index[ORDER].find(keys)
        found = self.value[ORDER][np.maximum(at, 0)]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            found[rest] = self._lower(keys[rest])
        full = np.flatnonzero(lengths > ORDER)
        starts = np.cumsum(lengths[full] - ORDER) - (lengths[full] - ORDER)
        out[np.array(rows)[full]] += np.add.reduceat(found, starts, axis=0, dtype=np.float64)

    def _lower(self, keys: np.ndarray) -> np.ndarray:
        """Values of grams that no language has seen at the highest order."""
        value = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            own = keys[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            at = self.gram_index[order].find(own)
            value[left[at >= 0]] += self.value[order][at[at >= 0]]
            left, own = left[at < 0], own[at < 0]
            context = self.context_index[order].find(own >> np.uint64(8))
            value[left[context >= 0]] += self.escape[order][context[context >= 0]]
        value[left] -= np.float32(np.log(256))
        return value


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", train_chars: int = 2_000_000) -> Model:
    """A model from the rows with text and language.

    Of each language whole documents are drawn by a hash of the text, so that
    ``train_chars`` characters (less where there are many languages: all together
    at most ``TRAIN_CHARS``) are expected. Copies are drawn together or not at all.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("_lang"), F.col(f"`{text}`").alias("_text")).where("_lang is not null and _text is not null")
    totals = rows.groupBy("_lang").agg(F.sum(F.length("_text")).alias("n")).collect()
    languages = sorted(r["_lang"] for r in totals if r["n"])
    each = min(train_chars, TRAIN_CHARS // max(1, len(languages)))
    number = {name: i for i, name in enumerate(languages)}
    shares = {r["_lang"]: each / r["n"] for r in totals if r["n"]}
    if not languages:
        return Model([], np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
    spark = labelled.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(k, number[k], float(v)) for k, v in shares.items()], "_lang string, _number int, _share double"))
    drawn = rows.join(chosen, "_lang").where((F.pmod(F.xxhash64(F.lit(3), "_text"), F.lit(1 << 30)) / float(1 << 30)) < F.col("_share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(grams(np.frombuffer(prepared(t), np.uint8), ORDER + 1))
            for k, some in by.items():
                keys, n = counted(np.concatenate(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["_number", "gram", "n"])

    found = drawn.select("_number", "_text").mapInArrow(count, "_number int, gram long, n long").groupBy("_number", "gram").agg(F.sum("n").alias("n")).toArrow()
    column = lambda name: found.column(name).to_numpy()
    return Model(languages, column("gram").astype(np.uint64), column("_number").astype(np.int64), column("n").astype(float))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the text alone.

    ``und`` and 0 for texts that are null or have no letter, and for all if no
    language was learned; of equally likely languages the first by name. Columns of
    these names are replaced; an empty table gives no rows.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = in_worker(("language model", number), lambda: shared.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            asked = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if own.languages else []
            for at in range(0, len(asked), 512):
                some = asked[at : at + 512]
                logs = own.log_probabilities([prepared(texts[i]) for i in some])
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                for i, b, s in zip(some, best.tolist(), share.tolist(), strict=True):
                    names[i], scores[i] = own.languages[b], s
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(names), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(id_col: Column, modulus: int) -> Column:
    """Whether the crc32 of the id as text leaves remainder 2; a null id is hashed as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus == 2
