"""SentencePiece encoding and decoding by a table of distinct marked words.

Where no piece of a vocabulary has a white-space marker after another sign, no
merge can join two marked words (a run of markers and the signs up to the next).
So each distinct marked word is segmented once and a text's ids are its words' ids
in order.  The most frequent words of the corpus are counted and segmented in
Spark and form a table of bounded size; each task adds the words that only its
own texts hold, segmented once each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Words in the table for all tasks, their longest length, and words a task keeps besides.
TABLE_WORDS = 50_000
TABLE_SIGNS = 48
TASK_WORDS = 200_000
_MARKER = "▁"
_WORD = re.compile(r" *[^ ]+| +")
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def model_of(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, read once in a worker; refused if a marked word could depend on its neighbours."""
    if path not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile(f"[^{_MARKER}]{_MARKER}")
        if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
            raise ValueError("pieces of this model cross white-space markers")
        if model.encode("a  b ", out_type=str)[0][:1] != _MARKER or model.decode(model.encode("  a  b ")) != "  a  b ":
            raise ValueError("this model changes white space or adds no marker in front")
        _models[path] = model
    return _models[path]


def marked_words(text: str) -> list[str]:
    """The marked words of a text, markers as blanks; the one in front is the marker that encoding adds."""
    return _WORD.findall(" " + text.replace(_MARKER, " ")) if text else []


def segment(model: sentencepiece.SentencePieceProcessor, word: str) -> tuple[int, str, str]:
    """Number of ids, the ids as text, and what they decode to, of one marked word."""
    # a lone marker has nothing behind the one that encoding adds, and an empty text gets none
    ids = model.encode(word[1:], num_threads=1) if len(word) > 1 else [model.piece_to_id(_MARKER)]
    return len(ids), " ".join(map(str, ids)), " " + model.decode(ids)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            seen.update(marked_words(text or ""))
        words = [w for w in seen if len(w) <= TABLE_SIGNS and seen[w] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])


def _segment_all(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            rows = [segment(model, w) for w in words]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(n, pa.int32()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["word", "n", "ids", "decoded"],
            )

    return run


def word_table(texts: DataFrame, path: str, size: int = TABLE_WORDS) -> dict[str, tuple[int, str, str]]:
    """The ``size`` most frequent marked words of all texts, segmented: at most that many short rows."""
    counted = texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = counted.orderBy(F.desc("n"), "word").limit(size).select("word")
    rows = chosen.mapInArrow(_segment_all(path), "word string, n int, ids string, decoded string").toPandas()
    return {w: (int(n), i, d) for w, n, i, d in rows.itertuples(index=False)}


def encode_column(text: Column, path: str, table: dict[str, tuple[int, str, str]], with_ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of a text column with an end id.

    Exactly the library's ids; decoding joins what the words decode to and drops
    the blank for the marker in front.  Null and empty texts are the end id alone.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.string()), ("decoded", pa.string())]
        kind += ", ids string, decoded string"

    @arrow_udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pa.Array) -> pa.Array:
        model = model_of(path)
        own: dict[str, tuple[int, str, str]] = {}
        end = str(model.eos_id())
        columns: list[list] = [[] for _ in fields]
        for value in texts:
            words = marked_words(value.as_py() or "")
            n, ids, back = 1, [], []
            for word in words:
                found = table.get(word) or own.get(word)
                if found is None:
                    found = segment(model, word)
                    if len(own) >= TASK_WORDS:
                        own.clear()
                    if len(word) <= TABLE_SIGNS:
                        own[word] = found
                n += found[0]
                ids.append(found[1])
                back.append(found[2])
            ids.append(end)
            line, decoded = " ".join(ids), "".join(back)[1:]
            row = [n, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), line, decoded]
            for column, cell in zip(columns, row, strict=False):
                column.append(cell)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])

    return run(text)


def encode_documents(documents: DataFrame, path: str, size: int = TABLE_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every row; repeated rows alike.

    An empty table gives no rows; long texts are encoded whole.
    """
    table = word_table(documents.select("text"), path, size)
    cells = encode_column(F.col("text"), path, table, with_ids)
    return documents.select("doc_id", cells.alias("_e")).select("doc_id", "_e.*")
