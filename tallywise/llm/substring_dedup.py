"""Substring deduplication with automata of repeated phrases.

A passage recurs if a window of WINDOW words of it also starts in a document with a smaller id.
Candidates are narrowed step by step: the least of the short runs in a window (its anchor) must
recur, then the hash of the window. Recurring windows that follow one another in two documents
are a phrase, which is read from the document with the smaller id. Tasks compile the phrases of
their documents into Aho-Corasick automata over words and stream the documents through them, so
that what is removed was found word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import ship_package, stored
from .buffers import Texts, mixed, runs_hash, slices, texts_of
from .shared import small, with_group

WINDOW = 13
# Words of an anchor; a window of 13 words holds nine runs of five, and equal windows the same least one.
ANCHOR = 5


def _hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word start: text number, and anchor and hash of the window that starts there; windows only."""
    starts, ends, owner = texts.words()
    words = texts.spans_hash(starts, ends)
    windows = runs_hash(words, WINDOW)
    whole = owner[: len(windows)] == owner[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
    least = runs_hash(words, ANCHOR)
    span = WINDOW - ANCHOR + 1
    two = np.minimum(least[:-1], least[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    anchors = np.minimum(eight[: len(windows)], least[span - 1 :][: len(windows)])
    return np.where(whole, owner[: len(windows)], -1), anchors, windows


def _sequence_hash(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and a hash of the whole sequence of words, per text."""
    starts, ends, owner = texts.words()
    count = np.bincount(owner, minlength=len(texts.offsets) - 1)
    first = np.cumsum(count) - count
    rank = np.arange(len(owner)) - first[owner]
    placed = mixed(texts.spans_hash(starts, ends) + mixed(rank.astype(np.uint64)))
    out = np.zeros(len(count), np.uint64)
    filled = np.flatnonzero(count)
    if len(filled):
        out[filled] = mixed(np.add.reduceat(placed, first[filled]))
    return count.astype(np.int64), out.view(np.int64)


def _copies(rows: DataFrame) -> DataFrame:
    """Ids with the hashes of their texts that a smaller id has as well, word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            count, sequence = _sequence_hash(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(sequence)], ["id", "n", "sequence"])

    hashed = rows.mapInArrow(run, "id long, n long, sequence long").filter(f"n >= {WINDOW} AND id IS NOT NULL")
    hashed = stored(hashed, "sequences")
    counted = with_group(hashed, ["n", "sequence"], "id", {"first": F.min("id")}, {"first": F.min("first")})
    return counted.filter("first < id").groupBy("id").agg(F.collect_set("sequence").alias("copies"))


def _kept_rows(batch: pa.RecordBatch, texts: Texts) -> np.ndarray:
    """Rows that are no copies: column 2 lists the sequence hashes of an id's copies."""
    _, sequence = _sequence_hash(texts)
    copies = batch.column(2).to_pylist()
    return np.array([not c or s not in c for c, s in zip(copies, sequence.tolist())], bool)


def phrases(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Passages to remove: id, and where each is found first (from_id, from_word, n_words)."""
    # Text and copy hashes of each row; copies are left out as wholes.
    marked = rows.filter("id IS NOT NULL").join(small(copies), "id", "left")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column(1))
            owner, anchors, _ = _hashes(texts)
            kept = (owner >= 0) & _kept_rows(batch, texts)[owner]
            order = np.lexsort((anchors[kept], owner[kept]))
            owner, anchors = owner[kept][order], anchors[kept][order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (anchors[1:] != anchors[:-1])
            ids = batch.column(0).to_numpy()[owner[new]]
            yield pa.RecordBatch.from_arrays([pa.array(anchors[new].view(np.int64)), pa.array(ids)], ["anchor", "id"])

    found = stored(marked.select("id", "text", "copies").mapInArrow(anchored, "anchor long, id long"), "anchors")
    several = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    # Both sides are tables, so Spark splits the partition of an anchor that very many documents have.
    recurring = found.join(stored(several.select("anchor"), "recurring"), "anchor")
    lists = stored(recurring.groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "lists")

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column(1))
            owner, anchors, windows = _hashes(texts)
            lists = batch.column(3)
            values, bounds = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            known = np.zeros(len(owner), bool)
            # Places without a window belong to the text before them.
            at = np.searchsorted(np.maximum.accumulate(owner), np.arange(batch.num_rows + 1))
            for i, kept in enumerate(_kept_rows(batch, texts)):
                if kept:
                    known[at[i] : at[i + 1]] = np.isin(anchors[at[i] : at[i + 1]], values[bounds[i] : bounds[i + 1]])
            known &= owner >= 0
            _, _, every = texts.words()
            first = np.searchsorted(every, np.arange(batch.num_rows))
            place = np.flatnonzero(known)
            ids = batch.column(0).to_numpy()[owner[place]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows[place].view(np.int64)), pa.array(ids), pa.array(place - first[owner[place]])],
                ["window", "id", "word"],
            )

    listed = marked.join(lists, "id").select("id", "text", "copies", "anchors")
    windows = stored(listed.mapInArrow(windowed, "window long, id long, word long"), "windows")
    first = windows.groupBy("window").agg(F.min(F.struct("id", "word")).alias("first"), F.max("id").alias("high"))
    first = first.filter("first.id < high")
    first = first.select("window", F.col("first.id").alias("from_id"), F.col("first.word").alias("from_word"))
    first = stored(first, "first")
    hits = windows.join(first, "window").filter("from_id < id").select("id", "word", "from_id", "from_word")
    # Windows that follow one another in both documents are one phrase.
    order = Window.partitionBy("id").orderBy("word")
    follows = [F.col(c) - F.lag(c).over(order) == step for c, step in (("word", 1), ("from_id", 0), ("from_word", 1))]
    begins = (~F.coalesce(follows[0] & follows[1] & follows[2], F.lit(False))).cast("long")
    runs = hits.withColumn("run", begins)
    runs = runs.withColumn("run", F.sum("run").over(order))
    joined = runs.groupBy("id", "run").agg(
        F.first("from_id").alias("from_id"), F.min("from_word").alias("from_word"), (F.count(F.lit(1)) + WINDOW - 1).alias("n_words")
    )
    return joined.select("id", "from_id", "from_word", "n_words").distinct()


def _spelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The words of each phrase, read from the document where it is found first."""
    wanted = found.select("from_id", "from_word", "n_words").distinct()
    wanted = wanted.groupBy(F.col("from_id").alias("id")).agg(F.collect_list(F.struct("from_word", "n_words")).alias("parts"))
    holding = rows.join(small(stored(wanted, "wanted")), "id").select("id", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for id_, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().split()
                for p in parts:
                    a, n = p["from_word"], p["n_words"]
                    if a + n <= len(words):
                        out.append((id_, a, n, b" ".join(words[a : a + n]).decode()))
            columns = list(zip(*out)) if out else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["from_id", "from_word", "n_words", "phrase"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return holding.mapInArrow(run, "from_id long, from_word long, n_words long, phrase string").distinct()


def _covered(documents: list[list[bytes]], found: list[list[dict]], ids: list[int]) -> list[np.ndarray]:
    """Which words of each document lie in a phrase from a smaller id: one automaton for all of them."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    lowest: dict[tuple, int] = {}
    for phrases_of_one in found:
        for p in phrases_of_one:
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in p["phrase"].encode().split())
            lowest[key] = min(p["from_id"], lowest.get(key, p["from_id"]))
    for key, low in lowest.items():
        automaton.add_word(key, (len(key), low))
    automaton.make_automaton()
    out = []
    for words, own, id_ in zip(documents, found, ids):
        edge = np.zeros(len(words) + 1, np.int64)
        if own:
            for end, (n, low) in automaton.iter(tuple(numbers.get(w, 0) for w in words)):
                if low < id_:
                    edge[end + 1 - n] += 1
                    edge[end + 1] -= 1
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, and the kept words joined by one space (``kept_text``).

    Words are runs of bytes other than space and tab to return. A word goes if a window of
    WINDOW words that covers it also starts in a document with a smaller id; windows are judged
    on the texts as they are, so a document that is cut itself still counts for later ones. With
    ``digest`` the SHA-256 of the kept text stands for it. Ids are whole numbers. Rows that
    repeat an id are one document for this purpose: they do not cut each other, and each is cut
    for itself. A row with a null id is neither cut nor a reason to cut. Null counts as empty.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    copies = stored(_copies(rows), "copies")
    found = stored(phrases(rows, copies), "found")
    spelled = stored(_spelled(rows, found), "spelled")
    each = found.join(spelled, ["from_id", "from_word", "n_words"]).select("id", "from_id", "phrase")
    lists = stored(each.groupBy("id").agg(F.collect_list(F.struct("from_id", "phrase")).alias("phrases")), "phrases")
    cut = rows.join(small(copies), "id", "left").join(lists, "id", "left").select("id", "text", "copies", "phrases")
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept_rows = _kept_rows(batch, texts_of(batch.column(1)))
            documents = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            own = [p or [] for p in batch.column(3).to_pylist()]
            covered = _covered(documents, own, batch.column(0).to_pylist())
            counts, removed, texts = [], [], []
            for words, gone, kept in zip(documents, covered, kept_rows):
                if not kept:
                    gone = np.ones(len(words), bool)
                rest = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                counts.append(len(words))
                removed.append(len(words) - len(rest))
                text = b" ".join(rest)
                texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_words", "n_removed", last])

    return cut.mapInArrow(run, f"`{id_column}` long, n_words long, n_removed long, {last} string")
