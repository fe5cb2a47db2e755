"""A run-length compressed Burrows-Wheeler index of many equally long strings, with samples at the run ends.

Of the sorted suffixes only the runs of the transform are kept: where a run starts, its byte, where its first row goes under the
last-to-first step, and the suffixes at its two ends. Matching statistics of other strings are streamed through the runs.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # no byte of UTF-8; ends each string


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of unsigned keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.empty(len(keys), dtype=np.int64)
    new[0] = 1
    np.cumsum(ranked[1:] != ranked[:-1], out=new[1:])
    new[1:] += 1
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = new.astype(np.uint64)
    return out


def sorted_suffixes(pad: np.ndarray) -> np.ndarray:
    """Places row * n + column of all suffixes of the rows of an (m, n) matrix in order, by prefix doubling.

    Every row ends with END, which is nowhere else and ends a suffix; equal suffixes stand in the order of their rows.
    """
    m, n = pad.shape
    wide = np.zeros((m, n + 8), dtype=np.uint8)
    wide[:, :n] = pad
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8, axis=1)[:, :n]).view(">u8").reshape(m, n).astype(np.uint64)
    rank, reach = _ranks(keys.ravel()).reshape(m, n), 8
    while reach < n:
        after = np.zeros((m, n), dtype=np.uint64)
        after[:, : n - reach] = rank[:, reach:]
        rank = _ranks(((rank << np.uint64(32)) | after).ravel()).reshape(m, n)
        reach *= 2
    return np.argsort((rank << np.uint64(32) | np.arange(m, dtype=np.uint64)[:, None]).ravel())


class RunLengthIndex:
    """Index of the rows of an (m, width) byte matrix without END."""

    def __init__(self, rows: np.ndarray):
        m, width = rows.shape
        self.n = width + 1
        self.text = np.full((m, self.n), END, dtype=np.uint8)
        self.text[:, :width] = rows
        sa = sorted_suffixes(self.text)
        row, at = sa // self.n, sa % self.n
        last = np.where(at > 0, self.text[row, at - 1], END)
        starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.total = len(sa)
        sizes = np.diff(np.append(starts, self.total))
        chars = last[starts]
        order = np.argsort(chars, kind="stable")
        first = np.zeros(len(starts), dtype=np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]  # bytes are sorted as first bytes of suffixes are
        self.run_start, self.run_size, self.run_char, self.run_first = starts, sizes, chars, first
        ends = starts + sizes - 1
        self.head_row, self.head_at, self.end_row, self.end_at = row[starts], at[starts], row[ends], at[ends]
        self.by_char = order  # runs by byte, then by place
        self.char_keys = (chars[order].astype(np.int64) << 40) | starts[order]

    def run_of(self, q: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.run_start, q, side="right") - 1

    def neighbours(self, c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last run of byte c that starts before rank q, first that starts at or behind it); -1 where there is none."""
        k = np.searchsorted(self.char_keys, (c.astype(np.int64) << 40) | q)
        before, behind = self.by_char[np.maximum(k - 1, 0)], self.by_char[np.minimum(k, len(self.by_char) - 1)]
        before = np.where((k > 0) & (self.run_char[before] == c), before, -1)
        return before, np.where((k < len(self.by_char)) & (self.run_char[behind] == c), behind, -1)

    def common(self, own: np.ndarray, row: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes, at most `most`, the rows of `own` have in common with the indexed suffixes (row, at)."""
        out, going = np.zeros(len(own), np.int64), np.arange(len(own))
        for j in range(own.shape[1]):
            going = going[(j < most[going]) & (at[going] + j < self.n)]
            if not len(going):
                break
            going = going[own[going, j] == self.text[row[going], at[going] + j]]
            out[going] += 1
        return out

    def matching_statistics(self, queries: np.ndarray, most: int, pivot: int | None = None) -> np.ndarray:
        """(k, width): for each place of each query the length of the longest match with an indexed row that begins there,
        `most` for any longer one.

        All queries are streamed from their ends to their beginnings. Where the byte in front of a match is not that of its
        rank in the transform, the match goes on from the end of the nearest run of that byte before or behind,
        whichever suffix sampled there has more in common. pivot: a query whose match doesn't reach this place is done.
        """
        k, width = queries.shape
        out = np.zeros((k, width), dtype=np.int64)
        padded = np.full((k, width + most), END, dtype=np.uint8)
        padded[:, :width] = queries
        going, q, length = np.arange(k), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for col in range(width - 1, -1, -1):
            c = queries[going, col]
            run = self.run_of(q)
            same = (self.run_char[run] == c) & (length > 0)
            to = self.run_first[run] + q - self.run_start[run]
            length = np.minimum(length + 1, most)
            other = np.flatnonzero(~same)
            if len(other):
                before, behind = self.neighbours(c[other], q[other])
                own, known = padded[going[other], col + 1 : col + 1 + most], np.where(same, 0, length - 1)[other]
                a = np.where(before >= 0, self.common(own, self.end_row[before], self.end_at[before], known), -1)
                b = np.where(behind >= 0, self.common(own, self.head_row[behind], self.head_at[behind], known), -1)
                take = np.where(a >= b, before, behind)
                to[other] = self.run_first[take] + np.where(a >= b, self.run_size[take] - 1, 0)
                length[other] = np.where(take >= 0, np.minimum(np.maximum(a, b) + 1, most), 0)
                to[other[take < 0]] = 0
            q = to
            out[going, col] = length
            if pivot is not None and col <= pivot:
                on = col + length > pivot
                if not on.all():
                    going, q, length = going[on], q[on], length[on]
        return out
