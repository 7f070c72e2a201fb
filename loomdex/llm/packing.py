"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, functions as F

from loomdex.llm.common import binary_column, slices

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS = 4096
#: Limits of instruction data: its conversations have a thousand tokens or so, of which four fifths bear loss.
CONVERSATION_LIMITS = (4096, 4, 3328)
OPEN_BINS = 32
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers; then it starts anew.
CACHED_WORDS = 1_000_000
#: Lower-case letters that Unicode's composition and case rules leave as they are.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


@dataclass(slots=True)
class Piece:
    item: object  # whatever identifies the example
    start: int  # in tokens
    length: int
    loss: int


class Packer:
    """Online packing with a bounded number of open bins.

    An example goes to the open bin that can hold it with the largest dot product of its
    demand and the bin's free room, both as fractions of the limits. Where none can: a new bin
    while fewer than ``open_bins`` are open; else with ``cut`` the fullest one is topped up with
    a first part of the example, without it the fullest one is closed.
    """

    def __init__(self, tokens=MAX_TOKENS, segments=MAX_SEGMENTS, loss=MAX_LOSS, open_bins=OPEN_BINS, cut=True):
        self.limits = (tokens, segments, loss)
        self.cut, self.n = cut, open_bins
        self.bins: list[list[Piece]] = [[] for _ in range(open_bins)]
        self.tokens, self.segments, self.loss = ([x] * open_bins for x in self.limits)  # room left

    def _put(self, k: int, p: Piece) -> Iterator[list[Piece]]:
        self.bins[k].append(p)
        self.tokens[k] -= p.length
        self.segments[k] -= 1
        self.loss[k] -= p.loss
        if not self.tokens[k] or not self.segments[k]:
            yield self._close(k)

    def _close(self, k: int) -> list[Piece]:
        done, self.bins[k] = self.bins[k], []
        self.tokens[k], self.segments[k], self.loss[k] = self.limits
        return done

    def _best(self, length: int, loss: int) -> int:
        """The open bin with the largest dot product, an unused one if none in use can hold the example, else -1."""
        cap, segments, most = self.limits
        a, b, c = length / cap**2, 1 / segments**2, loss / most**2
        best, score, empty = -1, -1.0, -1
        for k, (t, s, f) in enumerate(zip(self.tokens, self.segments, self.loss, strict=True)):
            if t >= length and f >= loss:
                if t == cap and s == segments:
                    empty = k
                elif (x := a * t + b * s + c * f) > score:
                    best, score = k, x
        return best if best >= 0 else empty

    def add(self, item, length: int, loss: int) -> Iterator[list[Piece]]:
        """Yields the pieces of each bin that is full. Without ``cut`` an example over a limit is a ValueError.

        With ``cut`` the loss-bearing tokens of a part are in proportion, rounded up.
        """
        cap, _, most = self.limits
        if not self.cut and (length > cap or loss > most):
            raise ValueError(f"example {item} of {length} tokens, {loss} loss-bearing, is over the limits")
        rate, start = loss / length, 0
        whole = cap if rate * cap <= most else max(1, int(most / rate))
        while length > whole:
            yield [Piece(item, start, whole, min(ceil(rate * whole), most))]
            start, length = start + whole, length - whole
        while length:
            need = min(ceil(rate * length), most)
            k = self._best(length, need)
            if k >= 0:
                yield from self._put(k, Piece(item, start, length, need))
                return
            k = min(range(self.n), key=self.tokens.__getitem__)
            part = min(length, self.tokens[k], int(self.loss[k] / rate) if rate else length) if self.cut else 0
            if not part:
                yield self._close(k)
                continue
            yield from self._put(k, Piece(item, start, part, min(ceil(rate * part), self.loss[k])))
            start, length = start + part, length - part

    def finish(self) -> Iterator[list[Piece]]:
        """What is left: as it lies without ``cut``; with it, run together and cut at powers of two, so nothing is padded."""
        if not self.cut:
            yield from (b for b in self.bins if b)
            return
        rest = [p for b in self.bins for p in b]
        left = sum(p.length for p in rest)
        cap, segments, most_loss = self.limits
        while left:
            size = cap if left >= cap else 1 << (left.bit_length() - 1)
            while True:
                taken, room = [], size
                for p in rest:
                    if not room:
                        break
                    n = min(p.length, room)
                    taken.append(Piece(p.item, p.start, n, -(-p.loss * n // p.length)))
                    room -= n
                if size == 1 or (len(taken) <= segments and sum(p.loss for p in taken) <= most_loss):
                    break
                size = 1 << ((size - 1).bit_length() - 1)
            yield taken
            left -= size
            last, p = taken[-1], rest[len(taken) - 1]
            rest = rest[len(taken) - 1 :]
            if last.length == p.length:
                rest = rest[1:]
            else:
                rest[0] = Piece(p.item, p.start + last.length, p.length - last.length, p.loss - last.loss)


class WordIds:
    """Ids of texts under a tokenizer that drops white space, word by word: ids never span a blank.

    Words are split at ASCII white space as bytes; a bounded table keeps each word's ids as
    little-endian unsigned 32-bit bytes, so a text's ids are one join. A Latin word, with or without
    full stops and commas behind it, is one piece of the tokenizer's own splitting once in lower
    case, so its letters go straight to the tokenizer's model; any other word takes the whole way.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level models
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out, known = [], self.known
        for text in texts:
            words = text.split()
            if new := set(words).difference(known):
                if len(known) > CACHED_WORDS:
                    known.clear()
                    new = set(words)
                self._learn(new)
            out.append(b"".join(map(known.__getitem__, words)))
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        known, letters, odd = self.known, self.letters, []
        if len(letters) > CACHED_WORDS:
            letters.clear()
        tokenize, alphabet = self.tokenizer.model.tokenize, self.alphabet
        for w in words:
            core = w.rstrip(b".,")
            s = core.decode("utf-8", "replace").lower()
            if not LATIN(s):
                odd.append(w)
                continue
            ids = letters.get(s)
            if ids is None:
                shown = s if s.isascii() else s.encode().decode("latin-1").translate(alphabet)
                ids = letters[s] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in known:
                    known[tail] = self._encode([tail.decode()])[0]
                ids += known[tail]
            known[w] = ids
        if odd:
            known.update(zip(odd, self._encode([w.decode("utf-8", "replace") for w in odd]), strict=True))


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pack_texts(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", limits=(MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition of ``docs`` packs by itself: no shuffle, bounded memory, and a lost task redoes
    only its own sequences. Loss-bearing tokens of a part are all but its first. sequence_id is the
    partition number times 2^40 plus a counter. Null or empty texts are the end id alone; repeated
    rows are packed as often as they come; null doc_id is kept; empty input gives no rows.
    ``tokenizer`` names a file of public_tokenizers or is a path.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import os

        import pyarrow as pa
        import public_tokenizers
        from pyspark import TaskContext

        ids_of = word_ids(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)).ids
        packer, held, end = Packer(*limits), {}, END_ID.to_bytes(4, "little")
        base, number, rows = TaskContext.get().partitionId() << 40, 0, []

        def emit(pieces):
            nonlocal number
            at = 0
            for p in pieces:
                slot = held[p.item]
                rows.append((slot[0], p.start, p.length, zlib.crc32(slot[1][4 * p.start : 4 * (p.start + p.length)]), len(slot[1]) // 4, base + number, at))
                at += p.length
                slot[2] -= p.length
                if not slot[2]:
                    del held[p.item]
            number += 1

        def batch():
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        serial = 0
        for b in slices(batches, 512):
            id_type = b.schema.field(0).type
            doc_ids = b.column(0).to_pylist()
            for doc_id, words in zip(doc_ids, binary_column(b, "text"), strict=True):
                data = ids_of([words or b""])[0] + end
                n = len(data) // 4
                serial += 1
                held[serial] = [doc_id, data, n]
                for done in packer.add(serial, n, n - 1):
                    emit(done)
            yield batch()
        for done in packer.finish():
            emit(done)
        if rows:
            yield batch()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def conversation_examples(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(example_id, tokens, loss_tokens) of conversations (conv_id, role, text): each turn is its text's ids and an end id;
    those of the assistant bear loss. Turns are counted where they are, so a long conversation never meets in one value.

    Null or empty texts are the end id alone; null roles bear no loss; null conv_id is one conversation; an empty table gives no rows.
    """

    def run(batches):
        import os

        import pyarrow as pa
        import public_tokenizers

        ids_of = word_ids(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)).ids
        for b in slices(batches, 512):
            n = [len(x) // 4 + 1 for x in ids_of([x or b"" for x in binary_column(b, "text")])]
            loss = [k if role == "assistant" else 0 for k, role in zip(n, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], ["example_id", "n", "loss"])

    c = conversations.select(F.col("conv_id").alias("example_id"), "role", "text")
    turns = c.mapInArrow(run, f"example_id {c.schema['example_id'].dataType.simpleString()}, n long, loss long")
    return turns.groupBy("example_id").agg(F.sum("n").alias("tokens"), F.sum("loss").alias("loss_tokens"))


def pack_examples(df: DataFrame, limits=(MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """Instruction data: rows (example_id, tokens, loss_tokens) stay whole; adds sequence_id and offset.

    Rows over a limit, or null or empty ones, get null sequence_id. Partitions pack by themselves.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer, base, number, rows, held = Packer(*limits, cut=False), TaskContext.get().partitionId() << 40, 0, [], {}

        def emit(pieces):
            nonlocal number
            at = 0
            for p in pieces:
                rows.append((*held.pop(p.item), base + number, at))
                at += p.length
            number += 1

        serial, schema = 0, None
        for b in batches:
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, tokens, loss = row
                if not tokens or tokens < 0 or loss is None or loss < 0 or tokens > limits[0] or loss > limits[2]:
                    rows.append((*row, None, None))
                    continue
                serial += 1
                held[serial] = row
                for done in packer.add(serial, tokens, loss):
                    emit(done)
            if rows:
                yield _as_batch(pa, schema, rows)
        for done in packer.finish():
            emit(done)
        if rows:
            yield _as_batch(pa, schema, rows)

    def _as_batch(pa, schema, rows):
        columns = list(zip(*rows, strict=True))
        rows.clear()
        kinds = [*schema.types, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*schema.names, "sequence_id", "offset"])

    d = df.select("example_id", "tokens", "loss_tokens")
    return d.mapInArrow(run, StructType([*d.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))
