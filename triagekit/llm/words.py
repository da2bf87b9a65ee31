"""BPE through a table of distinct words.

For a tokenizer that drops white space, the ids of a text are those of its words in order. Texts stay in
their files: for each block (a split of a file, which one task reads) the distinct words are collected;
all blocks' words meet in one table, where each is encoded once; the ids go back to the blocks that use
the word, as a small dictionary per block in the shared folder; each block reads its dictionary, joins
the ids of each word to the id-to-piece table (fixed in size, so held by every task), and puts ids and
pieces in place by the position of the words in its texts. ``decode`` is the same join for any lists of
ids, as a DataFrame. Only words move, never texts or positions, and a very frequent word has at most one row per block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.llm.encode import BYTE_LETTERS, load_tokenizer
from triagekit.sources.store import materialize, new_path

#: Distinct stretches between blanks whose words a task holds at a time.
MOST_STRETCHES = 400_000
#: Latin letters that stay letters in lower case, and the marks behind them: at most two words.
LATIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]*)([.,;:!?#$%&*|]*)")

_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


class Splitter:
    """The words of a stretch of text without blanks, as the tokenizer's normaliser and splitter give them.

    A blank always ends a word and is dropped, so a text has the words of its stretches. Special tokens
    stand for themselves. Plain words with marks behind them spare the library a call.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"]
        cuts = pre["pretokenizers"][0] if pre and pre["type"] == "Sequence" else {}
        if not (cuts.get("type") == "Split" and cuts.get("behavior") == "Removed" and cuts.get("invert")):
            raise ValueError("the word table needs a tokenizer that splits words and drops white space")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ordered = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(map(re.escape, ordered))})") if ordered else None

    def words(self, stretch: str) -> list[str]:
        if plain := LATIN.fullmatch(stretch):
            word, marks = plain.groups()
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
            return [w for w in (word, marks) if w]
        if self.at_special and (parts := self.at_special.split(stretch))[1:]:
            return [w for p in parts for w in ([p] if p in self.special else self._words(p))]
        return self._words(stretch)

    def _words(self, stretch: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(stretch) if stretch else ""
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)] if normal else []

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tokenizer.model.tokenize(word)]


def stretches_of(text: str | None) -> list[str]:
    return (text or "").replace("\n", " ").split(" ")


def block_words(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(block, word)`` for every word of a block; each once, or a few times where a block has very many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = splitter(tokenizer_path).words
        block, stretches, found = None, set(), set()

        def flush() -> Iterator[pa.RecordBatch]:
            new = {w for s in stretches for w in words(s)} - found
            found.update(new)
            stretches.clear()
            rows = sorted(new)
            for low in range(0, len(rows), 50_000):
                part = rows[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], names=["block", "word"])
            if len(found) > MOST_STRETCHES:
                found.clear()

        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != block:
                    yield from flush()
                    found.clear()
                    block = at
                stretches.update(stretches_of(text.as_py()))
                if len(stretches) > MOST_STRETCHES:
                    yield from flush()
        yield from flush()

    return docs.select("block", "text").mapInArrow(run, "block long, word string")


def word_table(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(word, ids)`` for each distinct word, encoded once; ids as text, joined by a blank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = splitter(tokenizer_path).ids
        for batch in batches:
            joined = [" ".join(map(str, ids(w))) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.string())], names=["word", "ids"])

    return words.select("word").distinct().mapInArrow(run, "word string, ids string")


def pieces(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """``(id, piece)`` of a vocabulary, special tokens included; as large as the tokenizer's file."""
    vocabulary = load_tokenizer(tokenizer_path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in sorted(vocabulary.items(), key=lambda x: x[1])], "id int, piece string")


def decode(lists: DataFrame, key: str, ids_col: str, vocabulary: DataFrame) -> DataFrame:
    """``(key, decoded)``: the pieces of each list of ids, joined by a blank as a tokenizer without
    decoder does. ``key`` is unique and not null; a null or empty list gives an empty text, ids outside
    the vocabulary give nothing."""
    at = lists.select(F.col(key).alias("k"), F.posexplode_outer(ids_col).alias("at", "id"))
    joined = at.join(F.broadcast(vocabulary.select("id", "piece")), "id", "left")
    ordered = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return joined.groupBy("k").agg(F.array_join(ordered["piece"], " ").alias("decoded")).select(F.col("k").alias(key), "decoded")


def _with_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the number of the split of the file that they lie in; other tables are written first."""
    rows = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    block = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("block")
    try:
        return docs.select(block, *rows)
    except AnalysisException:
        return materialize(docs.select(*rows), "texts").select(block, "doc_id", "text")


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def dictionaries(docs: DataFrame, tokenizer_path: str) -> str:
    """Writes the dictionary of each block: ``block=<number>/`` with the ids of each of its words."""
    used = materialize(block_words(docs, tokenizer_path), "block-words")
    entries = used.join(materialize(word_table(used, tokenizer_path), "words"), "word")
    folder = new_path(docs.sparkSession, "dictionaries")
    entries.select("block", "word", "ids").repartition("block").write.partitionBy("block").option("compression", "zstd").parquet(folder)
    return folder


def _dictionary(folder: str, block: int, piece_of: dict[str, str]) -> dict[str, tuple[int, str, str]]:
    """Number of ids, ids and decoded text of each word of a block; each word is decoded once, by
    joining its ids to the pieces."""
    files, path = pafs.FileSystem.from_uri(f"{folder}/block={block}")
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        return {}
    table = pads.dataset(path, filesystem=files, format="parquet", partitioning=None).to_table(columns=["word", "ids"])
    out = {}
    for word, ids in zip(table["word"].to_pylist(), table["ids"].to_pylist()):
        own = ids.split(" ") if ids else []
        out[word] = (len(own), ids, " ".join([piece_of[i] for i in own]))
    return out


def _joined(docs: DataFrame, tokenizer_path: str, schema: str, per_text, types: list[pa.DataType], id_col: str, text_col: str) -> DataFrame:
    rows = _with_blocks(docs, id_col, text_col)
    folder = dictionaries(rows, tokenizer_path)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    vocabulary = load_tokenizer(tokenizer_path).get_vocab(with_added_tokens=True)
    piece_of = docs.sparkSession.sparkContext.broadcast({str(i): p for p, i in vocabulary.items()})  # as large as its file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = splitter(tokenizer_path).words
        block, known, entry = None, {}, {}

        class Entries(dict):
            def __missing__(self, stretch: str) -> tuple | None:
                found = [known[w] for w in words(stretch)]
                if len(found) > 1:
                    n, ids, decoded = zip(*found)
                    found = [(sum(n), " ".join(ids), " ".join(decoded))]
                entry = found[0] if found else None
                if len(self) < MOST_STRETCHES:
                    self[stretch] = entry
                return entry

        for batch in batches:
            out = []
            for at, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != block:
                    block, known, entry = at, _dictionary(uri, at, piece_of.value), Entries()
                found = [e for e in map(entry.__getitem__, stretches_of(text.as_py())) if e]
                n, ids, decoded = zip(*found) if found else ((), (), ())
                out.append((key, *per_text(sum(n), " ".join(ids), " ".join(decoded))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.select("block", "doc_id", "text").mapInArrow(run, schema)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encoded_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids and the SHA-256 of ids and of the decoded text.

    A null text is empty and has no ids. Repeated rows and null ids are encoded like others; an empty
    table gives no rows. Other columns are ignored. Best on a table that is read from files; any other is
    written first.
    """

    def digest(n: int, ids: str, decoded: str) -> tuple:
        return n, _sha256(ids), _sha256(decoded)

    return _joined(docs, tokenizer_path, RESULT, digest, [pa.int64(), pa.int64(), pa.string(), pa.string()], id_col, text_col)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` per row, on the same terms."""

    def whole(n: int, ids: str, decoded: str) -> tuple:
        return list(map(int, ids.split())), decoded

    return _joined(
        docs, tokenizer_path, "doc_id long, ids array<int>, decoded string", whole, [pa.int64(), pa.list_(pa.int32()), pa.string()], id_col, text_col
    )
