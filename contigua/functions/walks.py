"""Paths among the k-mers of a block as numpy arrays: k-mers are words of up to 31 bases, k is odd.

An end is 2 i for the left one of node i and 2 i + 1 for the right one. A path enters a node by one end and leaves it by the other, so its places are ends, too,
and each path is there twice, once from either end.
"""

from __future__ import annotations

import numpy as np

from contigua.functions.windows import U, _text

_swaps = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def turned(x: np.ndarray, n: int) -> np.ndarray:
    """The reverse complements of words of n bases."""
    x = ~x
    for by, mask in _swaps:
        x = x >> U(by) & U(mask) | (x & U(mask)) << U(by)
    return x >> U(64 - 2 * n)


def packed(kmers: np.ndarray, k: int) -> np.ndarray:
    """Words of k-mers, given as bytes (rows x k)."""
    code = (kmers >> 1 & 3).astype(U)  # A, C, T, G
    code ^= code >> U(1)
    out = np.zeros(len(kmers), U)
    for i in range(k):
        out = out << U(2) | code[:, i]
    return out


def minimizers(word: np.ndarray, k: int, size: int) -> np.ndarray:
    """The smallest hash of the parts of `size` bases on either strand: that of the next k-mer is mostly the same."""
    size = min(size, k)
    back, mask, out = turned(word, k), U((1 << 2 * size) - 1), None
    for i in range(k - size + 1):
        x = np.minimum(word >> U(2 * i) & mask, back >> U(2 * (k - size - i)) & mask)
        x = (x + U(1)) * U(0x9E3779B97F4A7C15)
        x = (x ^ x >> U(29)) * U(0xBF58476D1CE4E5B9)
        out = x if out is None else np.minimum(out, x)
    return out ^ out >> U(32)


def mates(word: np.ndarray, l: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """The end that makes the same k + 1 bases as each end, or -1; where these are their own reverse complement the path ends."""
    step = np.empty(2 * len(word), U)
    step[::2], step[1::2] = l.astype(U) << U(2 * k) | word, word << U(2) | r.astype(U)
    back = turned(step, k + 1)
    key = np.minimum(step, back)
    order = np.argsort(key)
    same = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (step != back)[order[1:]])
    out = np.full(len(step), -1, np.int64)
    a, b = order[same], order[same + 1]
    out[a], out[b] = b, a
    return out


def walked(word: np.ndarray, l: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """walked_mates() of nodes."""
    return walked_mates(mates(word, l, r, k))


def walked_mates(mate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all paths, path by path (a path, then its mirror image), where each path begins, and the nodes that lie on circles; of each end its mate or -1."""
    ends = np.arange(len(mate))
    before = np.where(mate < 0, ends, mate ^ 1)
    d = (mate >= 0).astype(np.int64)
    # as many rounds as the longest path has binary digits; a circle never meets a head
    for _ in range(max(1, len(mate).bit_length())):
        if (mate[before] < 0).all():
            break
        d, before = d + d[before], before[before]
    on = mate[before] < 0
    # each path by the smaller of its own head and that of its mirror image, then by which of both it is
    last = np.flatnonzero(on & (mate[ends ^ 1] < 0))
    size, mirror = np.zeros(len(mate), np.int64), ends.copy()
    size[before[last]] = d[last] + 1
    mirror[before[last]] = last ^ 1
    heads = np.flatnonzero(size)
    heads = heads[np.lexsort((heads, np.minimum(heads, mirror[heads])))]
    # a path that is its own mirror image is joined to itself by a step that is its own reverse complement, and so is no single piece
    begin = np.zeros(len(mate), np.int64)
    begin[heads] = np.cumsum(size[heads]) - size[heads]
    places = np.empty(int(size.sum()), np.int64)
    at = ends[on]
    places[begin[before[at]] + d[at]] = at
    return places, begin[heads], np.flatnonzero(~on[::2])


def circle_starts(word: np.ndarray, l: np.ndarray, r: np.ndarray, k: int, circles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One node of each circle among the nodes `circles`, the first one, and the others."""
    mate = mates(word, l, r, k)
    least, ends = np.arange(len(mate)) >> 1, np.arange(len(mate))
    nxt = np.where(mate < 0, ends, mate[ends ^ 1])
    on = np.sort(np.r_[2 * circles, 2 * circles + 1])
    for _ in range(len(on).bit_length()):
        least[on], nxt[on] = np.minimum(least[on], least[nxt[on]]), nxt[nxt[on]]
    # both ways round meet the same nodes
    first = least[2 * circles] == circles
    return circles[first], circles[~first]


def sequences(places: np.ndarray, begin: np.ndarray, word: np.ndarray, l: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all paths, where each begins and the last one ends, l and r as codes, and the words of the k + 1 bases that lead into and out of each path."""
    node, back = places >> 1, (places & 1).astype(bool)
    here = np.where(back, turned(word[node], k), word[node])
    left, right = np.where(back, 3 - r[node], l[node]), np.where(back, 3 - l[node], r[node])
    size = np.diff(begin, append=len(places))
    at = np.r_[0, np.cumsum(size + k - 1)]
    text = np.empty(int(at[-1]), np.uint8)
    # the last base of each k-mer, then the k bases of the first one
    path = np.repeat(np.arange(len(begin)), size)
    text[np.arange(len(places)) + (k - 1) * (path + 1)] = np.frombuffer(b"ACGT", np.uint8)[(here & U(3)).astype(np.int64)]
    text[at[:-1, None] + np.arange(k)] = _text(here[begin], k)
    last = begin + size - 1
    into, out = left[begin].astype(U) << U(2 * k) | here[begin], here[last] << U(2) | right[last].astype(U)
    return text, at, left[begin], right[last], into, out


# Ends of pieces: nothing follows, another piece has the same k-mer there, or it is not known here what follows
DEAD, SHARED, LOOSE = 0, 1, 2


def of_block(word: np.ndarray, l: np.ndarray, r: np.ndarray, shared: np.ndarray, cut: np.ndarray, whole: bool, k: int) -> tuple[np.ndarray, ...]:
    """The paths among the nodes of a block, each once: bases and lengths as merged() has them, l, r, and the kinds of both ends.

    shared and cut have bits 1 and 2 for the left and right end: those whose junction (the k - 1 bases that neighbours have in common) is of another block, and those where nothing may
    follow. All nodes of a junction are in its block if that is `whole`.
    """
    # both copies of a shared node in one block are that node
    order = np.argsort(word)
    word, l, r, shared, cut = (x[order] for x in (word, l, r, shared, cut))
    at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    shared = np.bitwise_and.reduceat(shared, at)
    word, l, r, cut = (x[at] for x in (word, l, r, cut))
    step = np.empty(2 * len(word), U)
    step[::2], step[1::2] = l.astype(U) << U(2 * k) | word, word << U(2) | r.astype(U)
    of = lambda bits: np.stack([bits & 1, bits >> 1 & 1], axis=1).ravel().astype(bool)
    shared, cut = of(shared), of(cut)
    back = turned(step, k + 1)
    turns = step == back
    kind = np.where(cut, DEAD, np.where(shared, SHARED, np.where(turns, LOOSE, DEAD if whole else LOOSE))).astype(np.int8)
    open_ = np.flatnonzero(~(cut | shared | turns))
    key = np.minimum(step, back)[open_]
    order = np.argsort(key)
    open_, key = open_[order], key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    mate = np.full(len(step), -1, np.int64)
    mate[open_[same]], mate[open_[same + 1]] = open_[same + 1], open_[same]
    places, begin, circles = walked_mates(mate)
    places, begin = _one_of_each(places, begin)
    # what lies on a circle is left to itself, node by node
    begin = np.r_[begin, len(places) + np.arange(len(circles))]
    places = np.r_[places, 2 * circles]
    kind[np.r_[2 * circles, 2 * circles + 1]] = LOOSE
    last = np.r_[begin[1:], len(places)] - 1
    text, at, left, right, _, _ = sequences(places, begin, word, l, r, k)
    return _CODE[text], np.diff(at), left.astype(np.int8), right.astype(np.int8), kind[places[begin]], kind[places[last] ^ 1]


_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _one_of_each(places: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each path and its mirror image, which follows it, the first."""
    size = np.diff(begin, append=len(places))
    own = np.repeat(np.arange(len(begin)) % 2 == 0, size)
    return places[own], np.cumsum(size[::2]) - size[::2]


def end_words(bases: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The canonical words of the first and last k-mers of sequences (2 i and 2 i + 1), and whether each end is its word's right one."""
    at = np.cumsum(size) - size
    begin = np.stack([at, at + size - k], axis=1).ravel()
    word = np.zeros(len(begin), U)
    for i in range(k):
        word = word << U(2) | bases[begin + i].astype(U)
    back = turned(word, k)
    side = np.arange(len(begin)) % 2 == 1
    return np.minimum(word, back), side ^ (back < word)


def merged(bases: np.ndarray, size: np.ndarray, l: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Pieces (codes of all bases in a row, lengths, l, r, kinds of ends) after those that have a k-mer in common at their shared ends are one."""
    word, _ = end_words(bases, size, k)
    kind = np.stack([a, b], axis=1).ravel()
    ends = np.flatnonzero(kind == SHARED)
    ends = ends[np.argsort(word[ends], kind="stable")]
    same = np.flatnonzero(word[ends[1:]] == word[ends[:-1]])
    mate = np.full(len(kind), -1, np.int64)
    mate[ends[same]], mate[ends[same + 1]] = ends[same + 1], ends[same]
    places, begin, circles = walked_mates(mate)
    places, begin = _one_of_each(places, begin)
    kind[np.r_[2 * circles, 2 * circles + 1]] = LOOSE
    begin = np.r_[begin, len(places) + np.arange(len(circles))]
    places = np.r_[places, 2 * circles]
    last = np.r_[begin[1:], len(places)] - 1
    piece, back = places >> 1, (places & 1).astype(bool)
    # all but the first of a path without the k-mer that the one before ends with
    skip = np.full(len(places), k, np.int64)
    skip[begin] = 0
    length = size[piece] - skip
    first = (np.cumsum(size) - size)[piece]
    start = np.where(back, first + size[piece] - 1 - skip, first + skip)
    place = np.repeat(np.arange(len(places)), length)
    off = np.arange(len(place)) - np.repeat(np.cumsum(length) - length, length)
    turn = back[place]
    got = bases[start[place] + np.where(turn, -off, off)]
    got = np.where(turn, 3 - got, got).astype(np.uint8)
    p, q = piece[begin], piece[last]
    left = np.where(back[begin], 3 - r[p], l[p]).astype(np.int8)
    right = np.where(back[last], 3 - l[q], r[q]).astype(np.int8)
    return got, np.add.reduceat(length, begin) if len(begin) else length, left, right, kind[places[begin]], kind[places[last] ^ 1]


def folded(bases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of codes, four to a byte, and where each begins and the last one ends."""
    at = np.r_[0, np.cumsum(-(-size // 4))]
    out = np.zeros(4 * int(at[-1]), np.uint8)
    out[np.repeat(4 * at[:-1] - (np.cumsum(size) - size), size) + np.arange(len(bases))] = bases
    out = out.reshape(-1, 4)
    return out[:, 0] << 6 | out[:, 1] << 4 | out[:, 2] << 2 | out[:, 3], at


def unfolded(packed_: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The codes of folded() sequences."""
    out = (packed_[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()
    return out[np.repeat(4 * at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
