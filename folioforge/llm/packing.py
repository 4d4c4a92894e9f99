"""Cost-balanced packing of tokenised documents into sequences.

A document's ids are its tokens and an end id. Whole sequences are cut from it first; the rest of each document is assigned,
in descending order of cost (linear + quadratic in its length, as attention costs), to the lowest-cost sequence with room.
Where none has room, the piece is cut and its head fills the sequence with most room. Sequences are filled within a block
of about `block` ids of one input partition, so nothing is shuffled, a source's share of the rows doesn't matter, and a
block is short by less than one sequence. A lost task is simply run again: the same rows give the same sequences.

Null text is empty; an empty text is its end id alone. Repeated rows are packed each, and null ids stay null; pieces of equal
cost keep their order in the partition. Very long texts are encoded whole and cut. An empty table gives an empty result. Only
the id and text columns are read, so no other column can clash. Ids of sequences are unique but not consecutive.
"""

from __future__ import annotations

import heapq
import json
import os
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folioforge.llm import common as C

#: Words remembered before the older half is given up, and the longest that are.
MEMORY, LONGEST = 600_000, 48
#: Bytes of text encoded at a time.
AT_ONCE = 12_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(text: str) -> bool:
    """Latin letters alone, of which each has one small letter."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250" and "\u0130" not in text)


class Encoder:
    """Ids of texts. Where a vocabulary has word ends and small letters only, words are encoded once and remembered.

    New words of Latin letters alone are encoded as one text and told apart by their last tokens, which bear the word-end suffix;
    if the number of those isn't the number of words, each word is encoded by itself. Other words always are.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_str(spec)
        self.tool.encode_special_tokens = True
        self.plain = Tokenizer.from_str(spec)  # for composed small letters between spaces: nothing to normalise or split
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.tool.get_vocab_size(), bool)
        for token, k in self.tool.get_vocab().items():
            self.last[k] = bool(suffix) and token.endswith(suffix)
        self.wordwise = bool(suffix) and "Lowercase" in json.dumps(json.loads(spec)["normalizer"])
        self.points = {p: self._encode(self.tool, [chr(p)])[0].tobytes() for p in b".,"}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of_worker(cls, spec: str) -> Encoder:
        """One for each vocabulary and Python worker: what a task has learned serves the worker's later tasks."""
        held = sys.modules.setdefault("_folioforge_worker", types.ModuleType("_folioforge_worker"))
        key = zlib.crc32(spec.encode())
        if getattr(held, "encoder", (None,))[0] != key:
            held.encoder = (key, cls(spec))
        return held.encoder[1]

    def _encode(self, tool, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [k for k, t in enumerate(texts) if _latin(t)]
        parts = [plain[a : a + 1000] for a in range(0, len(plain), 1000)]
        joined = [unicodedata.normalize("NFC", " ".join([texts[k] for k in part])).lower() for part in parts]
        for part, ids in zip(parts, self._encode(self.plain, joined), strict=True):
            stops = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(stops) == len(part):
                raw = ids.tobytes()
                self.known.update(zip([words[k] for k in part], [raw[x:y] for x, y in zip([0, *stops], stops, strict=False)], strict=True))
        rest = [k for k, w in enumerate(words) if w not in self.known]
        for a in range(0, len(rest), 5_000):
            part = rest[a : a + 5_000]
            self.known.update(zip([words[k] for k in part], [x.tobytes() for x in self._encode(self.tool, [texts[k] for k in part])], strict=True))

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        if not self.wordwise:
            return self._encode(self.tool, [x.decode("utf-8", "replace") for x in bodies])
        split = [x.lower().split() for x in bodies]
        if len(self.known) > MEMORY:
            self.old, self.known = self.known, {}
        new = set().union(*split).difference(self.known)
        again = new.intersection(self.old)
        known = self.known
        known.update((w, self.old[w]) for w in again)
        new -= again
        ended = {w for w in new if w[-1] in b".," and (w[:-1].isalpha() or _latin(w[:-1].decode("utf-8", "replace")))}  # letters, then a token for the point or comma
        stems = {w[:-1] for w in ended}.difference(known)
        self._learn([*stems.difference(new), *(new - ended)])
        known.update((w, known[w[:-1]] + self.points[w[-1]]) for w in ended)
        find = known.__getitem__
        out = [np.frombuffer(b"".join(map(find, words)), "<u4") for words in split]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out


def gathered(batches: Iterator[pa.RecordBatch], size: int = AT_ONCE) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of about size bytes at a time: the more there are, the more words are shared."""
    doc_ids: list = []
    bodies: list[bytes] = []
    total = 0
    for batch in batches:
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids.append(doc_id)
            bodies.append(body.as_py())
            total += len(bodies[-1])
            if total >= size:
                yield doc_ids, bodies
                doc_ids, bodies, total = [], [], 0
    if bodies:
        yield doc_ids, bodies


def cost(length: int, quadratic: float) -> float:
    return length + quadratic * length * length


def assign(lengths: list[int], size: int, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) of documents of these lengths, all of their ids in as few sequences as hold them."""
    pieces, rest, n = [], [], 0
    for doc, length in enumerate(lengths):
        for k in range(length // size):
            pieces.append((doc, k * size, size, n))
            n += 1
        if length % size:
            rest.append((-cost(length % size, quadratic), doc, length - length % size, length % size))
    total = sum(x[3] for x in rest)
    room = [size] * -(-total // size)
    heap = [(0.0, k) for k in range(len(room))]
    heapq.heapify(rest)
    while rest:
        _, doc, start, length = heapq.heappop(rest)
        passed, chosen = [], None
        while heap:
            spent, k = heapq.heappop(heap)
            if room[k] >= length:
                chosen = (spent, k)
                break
            if room[k]:
                passed.append((spent, k))
        if chosen is None:  # no sequence has room for all of it
            chosen = max(passed, key=lambda x: (room[x[1]], -x[0], -x[1]))
            passed.remove(chosen)
            head = room[chosen[1]]
            heapq.heappush(rest, (-cost(length - head, quadratic), doc, start + head, length - head))
            length = head
        spent, k = chosen
        pieces.append((doc, start, length, n + k))
        room[k] -= length
        for x in passed:
            heapq.heappush(heap, x)
        if room[k]:
            heapq.heappush(heap, (spent + cost(length, quadratic), k))
    return pieces


def pack(docs: DataFrame, size: int = 4096, path: str | None = None, end_id: int = 2, quadratic: float = 1 / 4096, block: int = 2_000_000, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if with_ids."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = Encoder.of_worker(spec.value), TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        owners: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            pieces = sorted(assign([len(x) for x in ids], size, quadratic), key=lambda x: (x[3], x[0], x[1]))
            rows: list[list] = [[] for _ in range(8)]
            last, offset = -1, 0
            for doc, start, length, sequence in pieces:
                offset = 0 if sequence != last else offset
                part = np.ascontiguousarray(ids[doc][start : start + length])
                for k, v in enumerate((owners[doc], start, length, zlib.crc32(part), len(ids[doc]), first + sequence, offset, part.view(np.int32) if with_ids else None)):
                    rows[k].append(v)
                last, offset = sequence, offset + length
            first += last + 1
            columns = [pa.array(v, pa.int64()) for v in rows[:7]]
            return pa.RecordBatch.from_arrays(columns + [pa.array(rows[7], pa.list_(pa.int32()))] * with_ids, names[: 7 + with_ids])

        for doc_ids, bodies in gathered(batches):
            for doc_id, own in zip(doc_ids, encoder.encode(bodies), strict=True):
                ids.append(np.append(own, np.uint32(end_id)).astype("<u4"))
                owners.append(doc_id)
                held += len(ids[-1])
                if held >= block:
                    yield flush()
                    ids, owners, held = [], [], 0
        if ids:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{x} long" for x in names[:7]) + ", ids array<int>" * with_ids
    return C.keyed(docs, id_col, text_col).select("doc_id", "body").mapInArrow(run, schema)
