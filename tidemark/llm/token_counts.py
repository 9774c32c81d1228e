"""Tokens per text: distinct pieces of texts encoded in batches, only lengths kept."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tidemark.llm.training import free_name, with_column
from tidemark.llm.words import row_chunks, text_buffers

# Bytes of pieces given to the tokenizer at a time, of a stretch of a long text, and of the pieces whose lengths are remembered.
BATCH_BYTES, STRETCH_BYTES, MEMORY_BYTES = 64 << 10, 1 << 20, 32 << 20
# A space between two visible ASCII signs: no normaliser joins the sides, no pattern takes both.
_LONE_SPACE = re.compile(rb"(?<=[!-~])(?= [!-~])")
_BLANKS = "\t\n\v\f\r "


@dataclass
class Vocabulary:
    """A tokenizer's file: its bytes travel to the tasks, so that executors need no copy of the file."""

    kind: str
    data: bytes


def read_vocabulary(path: str) -> Vocabulary:
    """A ``.json`` file of the tokenizers library or a ``.model`` file of sentencepiece, read on the driver."""
    kind = os.path.splitext(path)[1]
    if kind not in (".json", ".model"):
        raise ValueError(f"neither .json nor .model: {path}")
    with open(path, "rb") as file:
        return Vocabulary(kind, file.read())


class Counter:
    """Counts tokens of texts. A text's pieces are encoded apart where that can't change its tokens."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.encode, self.rule = (_tokenizers if vocabulary.kind == ".json" else _sentencepiece)(vocabulary.data)

    def pieces(self, text: bytes) -> list[bytes]:
        if self.rule == "blank":
            return text.split()
        if self.rule == "whole" or not text:
            return [text] if text else []
        first, *others = _LONE_SPACE.split(text)
        return [first, *([p[1:] for p in others] if self.rule == "bare" else others)]

    def learn(self, pieces: set[bytes]) -> None:
        """Encode pieces in batches of about BATCH_BYTES."""
        batch, size = [], 0
        for piece in pieces:
            batch.append(piece)
            size += len(piece) + 16
            if size >= BATCH_BYTES:
                self._learn(batch)
                batch, size = [], 0
        self._learn(batch)

    def _learn(self, batch: list[bytes]) -> None:
        if batch:
            self.known.update(zip(batch, self.encode([p.decode("utf-8") for p in batch])))
            self.held += sum(map(len, batch)) + 64 * len(batch)

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; the texts together should be of bounded size."""
        if self.held > MEMORY_BYTES:
            self.known, self.held = {}, 0
        pieces = [self.pieces(t) for t in texts]
        self.learn(set().union(*pieces).difference(self.known))
        length = self.known.__getitem__
        return [sum(map(length, p)) for p in pieces]

    def count_long(self, text: bytes) -> int:
        """Tokens of one text, stretch by stretch."""
        parts = [text] if self.rule == "whole" else stretches(text)
        return sum(self.count([part[1:] if i and self.rule == "bare" else part])[0] for i, part in enumerate(parts))


Encode = Callable[[list[str]], list[int]]


def _tokenizers(data: bytes) -> tuple[Encode, str]:
    """The function that counts, and the rule for pieces: white space that leaves no trace separates them
    ("blank"), else each takes the space before it along ("space"), or there are none ("whole")."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_buffer(data)
    own.no_truncation()
    own.no_padding()

    def encode(pieces: list[str]) -> list[int]:
        return [len(e) for e in own.encode_batch_fast(pieces, add_special_tokens=False)]

    if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in own.get_added_tokens_decoder().values()):
        return encode, "whole"
    blank, joined, spaced = (own.encode(t, add_special_tokens=False).ids for t in (_BLANKS, "ab cd.", " ab\n\t cd. \r"))
    if not blank and joined == spaced:
        return encode, "blank"
    split = [i for t in ("ab", " cd", " ef.") for i in own.encode(t, add_special_tokens=False).ids]
    return encode, "space" if own.encode("ab cd ef.", add_special_tokens=False).ids == split else "whole"


def _sentencepiece(data: bytes) -> tuple[Encode, str]:
    """As above; the model puts a space before every text, so a piece goes without its own ("bare")."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_proto=data)
    same = own.encode("ab cd ef.") == [i for t in ("ab", "cd", "ef.") for i in own.encode(t)]
    return (lambda pieces: [len(e) for e in own.encode(pieces, num_threads=1)]), "bare" if same else "whole"


def stretches(text: bytes, limit: int = STRETCH_BYTES) -> Iterator[bytes]:
    """A long text in stretches of about ``limit`` bytes, cut before a lone space; without one it stays whole."""
    low = 0
    while len(text) - low > limit:
        cut = _LONE_SPACE.search(text, low + limit)
        if cut is None:
            break
        yield text[low:cut.start()]
        low = cut.start()
    yield text[low:] if low else text


def _pieces_of(vocabulary) -> Callable[[pa.Array], Iterator[pa.Array]]:
    made: list[Counter] = []

    def of(column: pa.Array) -> Iterator[pa.Array]:
        if not made:
            made.append(Counter(vocabulary.value))
        counter, (data, offsets) = made[0], text_buffers(column)
        for first, last in row_chunks(offsets, STRETCH_BYTES):
            texts = [data[offsets[i]:offsets[i + 1]].tobytes() for i in range(first, last)]
            if last - first == 1 and len(texts[0]) > STRETCH_BYTES:
                yield pa.array([counter.count_long(texts[0])], pa.int64())
            else:
                yield pa.array(counter.count(texts), pa.int64())
    return of


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of their whole text, as the library of the vocabulary's file counts them.

    No begin, end or other special tokens are added, texts are neither cut nor padded, and special strings
    inside a text are handled as is the library's default. Tasks take texts in stretches of about
    STRETCH_BYTES, split them where that can't change a token (at white space where the tokenizer drops
    it, else at single spaces between visible ASCII signs), and encode only pieces whose length they don't
    remember, in batches of about BATCH_BYTES. A text without such a place is encoded whole. Null and empty
    texts have 0 tokens. Repeated rows and null ids are counted like any other; columns pass through, but
    one called like ``count_col`` is replaced. An empty table gives no rows.
    """
    docs = docs.drop(count_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    made = free_name(docs, "token_count")
    return with_column(docs, text_col, made, T.LongType(), _pieces_of(shared)).withColumnRenamed(made, count_col)
