"""Encoding of whole texts into the tokens of a byte-level BPE vocabulary, and back.

Tokens are those that the ``tokenizers`` library gives for the whole text.  Its file is
read by the driver from a path that is a parameter, and broadcast.

Long texts are encoded by tree concatenation.  A text is cut every ``PIECE`` code points,
wherever that falls, and its pieces are rows that many tasks encode.  Neighbours are then
joined, pairs first, pairs of pairs next:

* A window around the join is encoded anew.  It grows until both its edges are places
  where either side is split whatever stands further away (a change between letters,
  digits, other signs and white space).  The tokens outside of it are those of the sides.
* Where the window meets no such place, it lies in one long run, such as a word of a
  million letters.  There the tokens themselves are the window: the last ones of the left
  and the first ones of the right side are merged anew, twice as many each time, until
  the outermost tokens that come out are those that went in.  Merges of a byte pair
  encoding are decided between neighbours: a sequence whose every two neighbours merge to
  just these two is the encoding of its text.

Missing texts count as empty and have no tokens.  Every row of the input is one row of the
result, repeated rows and ids included; other columns are left out.  The special strings
of the vocabulary are single tokens, as the library has it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shingles import chunks

#: code points of a text that are encoded at once
PIECE = 1 << 14
#: tokens on either side of a join that the first window holds
WINDOW = 16
#: a window of so many code points that still meets no split lies in one run
RUN = 1 << 12

# --- fixed value: how byte-level encodings of this kind split a text -------------
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters whose kind has been the same in all versions of Unicode are not rare
_RARE = re.compile("[^\x00-\u017f‐-‧€]")

LETTER, DIGIT, SPACE, SIGN = "letter", "digit", "space", "sign"

_codecs: dict[int, Codec] = {}


def byte_signs() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others in order for characters from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Codec:
    """One vocabulary in a Python worker."""

    def __init__(self, file: str) -> None:
        # one thread per task: Spark runs as many tasks as there are cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        signs = byte_signs()
        self.sign_of = {byte: sign for sign, byte in signs.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {x["id"]: x["content"] for x in json.loads(file)["added_tokens"]}
        self.special_strings = tuple(special.values())
        table = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, number in vocabulary.items():
            if number not in special:
                table[number] = bytes(signs[c] for c in token)
        for number, content in special.items():
            table[number] = content.encode()
        self.bytes_of = table
        self.sizes = np.array([len(x) for x in table], dtype=np.int64)
        self.special = np.zeros(len(table), dtype=bool)
        self.special[list(special)] = True
        self.kinds: dict[str, str] = {}
        self.fast = self._fast(json.loads(file)["model"]["merges"])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype="<u4") for x in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """Tokens of each text, as little-endian bytes.

        Texts of common characters, about which all libraries agree, go to the faster of
        two libraries; others, and those with special strings, to ``tokenizers`` itself.
        """
        made: list[bytes | None] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast and not _RARE.search(text) and not self.has_special(text):
                made[i] = array("I", self.fast.encode_ordinary(text)).tobytes()
            else:
                rest.append(i)
        found = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, tokens in zip(rest, found):
            made[i] = array("I", tokens.ids).tobytes()
        return made

    def has_special(self, text: str) -> bool:
        return any(x in text for x in self.special_strings)

    def _fast(self, merges: list) -> tiktoken.Encoding | None:
        """The same vocabulary by ranks, if its tokens are numbered as they are merged."""
        first = len(self.sign_of)
        tokens = [self.tokenizer.id_to_token(first + n) for n in range(len(merges))]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        if tokens != ["".join(pair) for pair in pairs]:
            return None
        ranks = {raw: n for n, raw in enumerate(self.bytes_of) if raw and not self.special[n]}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def merge(self, raw: bytes) -> np.ndarray:
        """Tokens of bytes that no split divides."""
        found = self.tokenizer.model.tokenize("".join(map(self.sign_of.__getitem__, raw)))
        return np.array([x.id for x in found], dtype=np.uint32)

    # --- cutting ---------------------------------------------------------------
    def pieces(self, text: str, size: int) -> list[str]:
        """The text cut every ``size`` code points, but not inside a special string."""
        cuts = [0]
        while cuts[-1] + size < len(text):
            at = cuts[-1] + size
            for special in self.special_strings:
                found = text.rfind(special, max(0, at - len(special) + 1), at + len(special) - 1)
                if found >= 0 and found < at:
                    at = found + len(special)
            cuts.append(at)
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]) if a < b]

    # --- splits that hold whatever stands further away --------------------------
    def kind(self, c: str) -> str:
        """What the library takes a character for, asked of the library itself."""
        found = self.kinds.get(c)
        if found is None:
            tests = ((LETTER, "a"), (DIGIT, "1"), (SPACE, "\t"))
            joined = (kind for kind, before in tests if len(self.split(before + c)) == 1)
            found = self.kinds[c] = next(joined, SIGN)
        return found

    def splits(self, before: str, after: str) -> bool:
        """Whether the library always splits between two neighbours.

        It does where the kind changes, unless the first is white space, which may belong
        to what follows, or an apostrophe in front of a letter, which may be a short form.
        """
        first, second = self.kind(before), self.kind(after)
        return first not in (SPACE, second) and not (before == "'" and second == LETTER)

    def first_split(self, text: str) -> int | None:
        at = (i for i in range(1, len(text)) if self.splits(text[i - 1], text[i]))
        return next(at, None)

    def last_split(self, text: str) -> int | None:
        at = (i for i in range(len(text) - 1, 0, -1) if self.splits(text[i - 1], text[i]))
        return next(at, None)

    # --- joining ---------------------------------------------------------------
    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of two texts put together, from the tokens of each."""
        if not len(left) or not len(right) or self.special[left[-1]] or self.special[right[0]]:
            return np.concatenate([left, right])
        width, begin, end = WINDOW, None, None
        while begin is None or end is None:
            if begin is None:
                tail, covered = self._side(left[::-1][:width], len(left))
                ahead = self.raw(tail[::-1])
                # a token may begin inside a character
                ahead = ahead[next((i for i, b in enumerate(ahead) if b & 0xC0 != 0x80), 0) :]
                ahead = ahead.decode()
                begin = 0 if covered else self.first_split(ahead)
            if end is None:
                head, covered = self._side(right[:width], len(right))
                behind = self.raw(head).decode("utf-8", "ignore")
                end = len(behind) if covered else self.last_split(behind)
            width *= 2
        ahead, behind = ahead[begin:], behind[:end]
        new = None
        if len(ahead) + len(behind) > RUN:
            new = self._join_run(ahead, behind, left, right)
        if new is None:
            new = self.encode([ahead + behind])[0]
        kept = len(left) - self._count(left[::-1], len(ahead.encode()))
        return np.concatenate([left[:kept], new, right[self._count(right, len(behind.encode())) :]])

    def _side(self, tokens: np.ndarray, total: int) -> tuple[np.ndarray, bool]:
        """Tokens from the join outwards, up to a special one, and whether these are all."""
        marks = np.flatnonzero(self.special[tokens])
        return (tokens[: marks[0]], True) if len(marks) else (tokens, len(tokens) == total)

    def _count(self, tokens: np.ndarray, size: int) -> int:
        """How many of the first tokens have ``size`` bytes together."""
        if not size:
            return 0
        sums = np.cumsum(self.sizes[tokens])
        at = int(np.searchsorted(sums, size))
        assert sums[at] == size, "the edge of a window is an edge of a token"
        return at + 1

    def _join_run(
        self, ahead: str, behind: str, left: np.ndarray, right: np.ndarray
    ) -> np.ndarray | None:
        """Tokens of a window that holds one long run across the join.

        None where the sides are split in another way than the window as a whole.
        """
        here = len(ahead)
        spans = lambda text: [span for _, span in self.split(text)]
        together, first, second = spans(ahead + behind), spans(ahead), spans(behind)
        run = next(((a, b) for a, b in together if a < here < b), None)
        expected = first[:-1] + [(first[-1][0], here + second[0][1])]
        expected += [(a + here, b + here) for a, b in second[1:]]
        if run is None or together != expected:
            return None
        size = lambda text: len(text.encode())
        n_left = self._count(left[::-1], size(ahead[run[0] :]))
        n_right = self._count(right, size(behind[: run[1] - here]))
        merged = self._merge_run(left[len(left) - n_left :], right[:n_right])
        in_left = self._count(left[::-1], size(ahead))
        in_right = self._count(right, size(behind))
        return np.concatenate(
            [left[len(left) - in_left : len(left) - n_left], merged, right[n_right:in_right]]
        )

    def _merge_run(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of one run from those of its two halves."""
        width = WINDOW
        while True:
            tail, head = left[-width:], right[:width]
            new = self.merge(self.raw(tail) + self.raw(head))
            agrees_left = len(tail) == len(left) or new[0] == tail[0]
            agrees_right = len(head) == len(right) or new[-1] == head[-1]
            if agrees_left and agrees_right:
                return np.concatenate([left[: len(left) - len(tail)], new, right[len(head) :]])
            width *= 2

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """The tree: neighbours are joined until one is left."""
        while len(parts) > 1:
            pairs = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0] if parts else np.empty(0, np.uint32)


def codec(file: Broadcast) -> Codec:
    """The worker's codec, built once from the broadcast file."""
    number = hash(file.value)
    if number not in _codecs:
        _codecs.clear()
        _codecs[number] = Codec(file.value)
    return _codecs[number]


def vocabulary(docs: DataFrame, path: str) -> Broadcast:
    """The vocabulary's file, sent to the executors once (some megabytes)."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encoded(docs: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """``doc_id, ids`` of every row: ``ids`` holds unsigned 32-bit integers, little-endian."""
    file = vocabulary(docs, path)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = texts.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(file)
        for batch in batches:
            values = batch["text"].tolist()
            for part in chunks(values):
                ids = own.encode_raw(values[part])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].to_numpy(), "ids": ids})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(file)
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                parts = own.pieces(text, piece)
                made = {"row": row, "part": range(len(parts)), "doc_id": doc_id, "text": parts}
                yield pd.DataFrame(made)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(file)
        for batch in batches:
            values = batch["text"].tolist()
            for part in chunks(values):
                rows = batch.iloc[part][["row", "part", "doc_id"]]
                yield rows.assign(ids=own.encode_raw(values[part]))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order; the pieces of a text may lie in several batches."""
        own = codec(file)
        row, doc_id, parts = None, None, []

        def done() -> pd.DataFrame:
            ids = own.joined(parts).tobytes()
            return pd.DataFrame({"doc_id": [doc_id], "ids": [ids]}).convert_dtypes(False)

        for batch in batches:
            for at, ident, ids in zip(batch["row"], batch["doc_id"], batch["ids"]):
                if at != row:
                    if parts:
                        yield done()
                    row, doc_id, parts = at, ident, []
                parts.append(np.frombuffer(ids, dtype="<u4"))
        if parts:
            yield done()

    result = f"doc_id {key}, ids binary"
    is_long = F.length("text") > piece
    short = texts.where(~is_long).mapInPandas(whole, result)
    pieces = (
        texts.where(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInPandas(cut, f"row long, part int, doc_id {key}, text string")
        .repartition("row", "part")
        .mapInPandas(encode, f"row long, part int, doc_id {key}, ids binary")
    )
    ordered = pieces.repartition("row").sortWithinPartitions("row", "part")
    return short.unionByName(ordered.mapInPandas(join, result))


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, what the bytes of all tokens in ``ids`` spell."""
    file = vocabulary(tokens, path)

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(file)
        for batch in batches:
            yield batch.map(lambda ids: own.decode(np.frombuffer(ids, dtype="<u4")))

    return tokens.withColumn("text", spell("ids"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number and digest of its tokens, digest of the text they spell."""
    return decoded(encoded(docs, path), path).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 AS long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
