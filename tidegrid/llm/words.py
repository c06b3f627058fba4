"""Texts as stretches that a byte-level tokenizer encodes alone, with each distinct stretch encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidegrid.llm.common import offsets_of

#: A space before what is no white space begins a pre-token; white space before it ends one. Most stretches are a run of
#: letters and then one of marks, a pre-token each.
SPACED = re.compile(r" (?=\S)")
MARKS = ".,;:!?$%&*#|()\"-_+=/<>[]{}@^~`\\"
LOOSE = r" [\s\p{Z}\x{85}\x{1c}-\x{1f}]"

#: Runs of a kind -> their ids end to end, and how many each has.
Runs = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def stretches(texts: pa.Array) -> pa.Array:
    """Each text cut at such spaces. Joined by spaces the stretches give the text again; an empty text is one stretch."""
    loose = pc.match_substring_regex(texts, LOOSE)
    if not pc.any(loose).as_py():
        return pc.split_pattern(texts, " ")
    odd = np.flatnonzero(loose.to_numpy(zero_copy_only=False))
    cut = pa.array([SPACED.split(t) for t in texts.take(pa.array(odd)).to_pylist()], pa.list_(texts.type))
    even = np.flatnonzero(~loose.to_numpy(zero_copy_only=False))
    both = pa.concat_arrays([pc.split_pattern(texts.take(pa.array(even)), " "), cut])
    return both.take(pa.array(np.argsort(np.r_[even, odd], kind="stable")))


def encode_column(texts: pa.Array, letters: Runs, marks: Runs, alone: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts (null: empty) end to end, and where each text's begin, with the end.

    letters: ids and their numbers, for runs of letters with a space before each; marks: for runs of other marks; alone:
    ids, as bytes, of any stretches. Each gets distinct stretches, so a word that is common in the slice costs once.
    """
    cut = stretches(texts.fill_null(""))
    edges, values = offsets_of(cut), cut.values
    if len(cut) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    values = values.slice(int(edges[0]), int(edges[-1] - edges[0]))
    edges = edges - edges[0]
    coded = values.dictionary_encode()
    whole = coded.dictionary
    stem = pc.ascii_rtrim(whole, characters=MARKS)
    plain = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False)
    left = pa.array(plain)
    word, tail = stem.filter(left).dictionary_encode(), _ends(whole.filter(left), stem.filter(left)).dictionary_encode()
    firsts = values.take(pa.array(edges[:-1])).to_pylist()
    odd = alone([*(" " + w for w in whole.filter(pa.array(~plain)).to_pylist()), *firsts])
    (ids1, n1), (ids2, n2) = letters(word.dictionary), marks(tail.dictionary)
    flat = np.concatenate([ids1, ids2, np.frombuffer(b"".join(odd), "<u4")])
    size = np.concatenate([n1, n2, np.fromiter(map(len, odd), np.int64, len(odd)) // 4, [0]])
    begin = np.cumsum(size) - size
    # each distinct stretch is two rows of the table: a word and its closing marks, or itself and nothing
    rows = np.full((len(plain) + len(cut), 2), len(size) - 1)
    rows[: len(plain)][plain, 0] = word.indices.to_numpy()
    rows[: len(plain)][plain, 1] = len(n1) + tail.indices.to_numpy().astype(np.int64)
    others = np.r_[~plain, np.ones(len(cut), bool)]
    rows[others, 0] = len(n1) + len(n2) + np.arange(len(odd))
    index = coded.indices.to_numpy().astype(np.int64)
    index[edges[:-1]] = len(plain) + np.arange(len(cut))
    at = rows[index].ravel()
    return gather(flat, begin, size, at), np.r_[0, np.cumsum(size[at])][2 * edges]


def _ends(whole: pa.Array, stem: pa.Array) -> pa.Array:
    """What follows stem in each of whole."""
    data, sizes = bytes_of(whole)
    kept = np.diff(offsets_of(stem))
    begin = np.cumsum(sizes) - sizes + kept
    ends = gather(data, begin, sizes - kept, np.arange(len(sizes)))
    places = np.r_[0, np.cumsum(sizes - kept)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(ends.tobytes())])


class Remembered:
    """Runs, with the ids of those met before kept for later slices; all are forgotten beyond a number of entries."""

    def __init__(self, work: Runs, entries: int = 200_000, longest: int = 48) -> None:
        self.work, self.entries, self.longest = work, entries, longest
        self.forget()

    def forget(self) -> None:
        self.runs, self.ids, self.counts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """runs: distinct strings."""
        met = pc.index_in(runs, value_set=self.runs)
        fresh = runs.filter(met.is_null())
        ids, counts = self.work(fresh)
        place = met.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.runs) + np.arange(len(fresh))
        flat, size = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        out = gather(flat, np.cumsum(size) - size, size, place), size[place]
        if len(self.runs) + len(fresh) > self.entries:
            self.forget()
        short = np.diff(offsets_of(fresh)) <= self.longest
        if len(self.runs) + short.sum() <= self.entries:
            self.runs = pa.concat_arrays([self.runs, fresh.filter(pa.array(short))])
            self.ids, self.counts = np.concatenate([self.ids, ids[np.repeat(short, counts)]]), np.concatenate([self.counts, counts[short]])
        return out


def as_binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column over data; row k has the items from edges[k] to edges[k + 1]."""
    places = (edges * data.itemsize).astype(np.int64)
    kind, width = (pa.binary(), np.int32) if places[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    made = pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(places.astype(width).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return made


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The rows index[0], index[1], ... of a ragged table, end to end."""
    sizes = size[index]
    ends = np.cumsum(sizes)
    return flat[np.repeat(begin[index] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of strings end to end, and the number of each."""
    edges, raw = offsets_of(strings), strings.buffers()[2] if len(strings) else None
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return data, np.diff(edges)
