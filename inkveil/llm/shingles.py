"""Hashes of words and of runs of five words, in numpy over whole batches of texts.

A word is a maximal run of bytes that are not ASCII white space. A text of n
words has n - 4 runs of five words; a text of one to four words has one run, of
all its words; a text without words, or NULL, has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: bytes that are hashed at once; a longer text is cut at white space
PIECE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
_PLACES = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                    0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finalizer (splitmix64): every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(PIECE, n) + 2
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, base, dtype=_U)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.empty(0, _U), starts
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * down[starts]
    return mix(own + (ends - starts).astype(_U) * _U(0xD1B54A32D192ED03)), starts


def _pieces(blob: bytes) -> Iterator[bytes]:
    at = 0
    while len(blob) - at > PIECE:
        found = _BREAK.search(blob, at + PIECE)
        if not found:
            break
        yield blob[at : found.start()]
        at = found.start()
    yield blob[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and where each text's begin."""
    hashes, counts, together, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        if together:
            own, starts = _piece_hashes(b"\n".join(together))
            begins = np.cumsum([0] + [len(x) + 1 for x in together])
            hashes.append(own)
            counts.extend(np.diff(np.searchsorted(starts, begins)).tolist())
            together.clear()
            size = 0

    for text in texts:
        blob = (text or "").encode("utf-8", "surrogatepass")
        if len(blob) > PIECE:
            flush()
            parts = [_piece_hashes(x)[0] for x in _pieces(blob)]
            hashes.extend(parts)
            counts.append(sum(map(len, parts)))
            continue
        if size + len(blob) > PIECE:
            flush()
        together.append(blob)
        size += len(blob) + 1
    flush()
    all_words = np.concatenate(hashes) if hashes else np.empty(0, _U)
    return all_words, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words in order, repeats included, and where each text's begin."""
    words, begins = word_hashes(texts)
    lengths = np.diff(begins)
    if not len(words):
        return np.empty(0, _U), np.zeros(len(texts) + 1, np.int64)
    padded = np.concatenate([words, np.zeros(WORDS - 1, _U)])
    runs = padded[: len(words)] * _PLACES[0]
    for i in range(1, WORDS):
        runs += padded[i : i + len(words)] * _PLACES[i]
    keep = np.zeros(len(words), dtype=bool)
    for text in np.flatnonzero(lengths):
        at, n = begins[text], lengths[text]
        keep[at : at + max(1, n - WORDS + 1)] = True
        if n < WORDS:
            runs[at] = (words[at : at + n] * _PLACES[:n]).sum(dtype=_U) + _U(n)
    sizes = np.where(lengths > 0, np.maximum(lengths - WORDS + 1, 1), 0)
    return mix(runs[keep]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed constants of n hash functions h -> (h ^ c) * a."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seeds[:n] | _U(1), seeds[n:]


def chunks(texts: list, most: int = 2 << 20, rows: int = 1024) -> Iterator[slice]:
    """Slices of a batch of so many rows and characters at most, one text at least."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if (size > most or i - at >= rows) and i > at:
            yield slice(at, i)
            at, size = i, len(text or "")
    if at < len(texts):
        yield slice(at, len(texts))
