"""Same or near-same records across splits.

Candidates come from an exact prefix filter on word multisets: the words of all texts are put in one order, rarest first,
and a pair of the wanted similarity must have a word in common so early in both that enough words follow it. No pair is
lost by that, however its words were edited or moved. Bounds by sketches and token histograms, which lose none either,
thin the candidates; what is left is verified exactly on the word multisets.

Evaluation texts are written in a normalised form of one character a word, and every passage of WINDOW words of them is
a pattern. An Aho-Corasick automaton of the passages of a batch's candidates scans their training texts, and the matched
intervals are merged into the share of an evaluation text they cover: 1 for an exact copy. As similarity doesn't heed
the order of words, a near-same text may hold no passage intact, so coverage decides on no pair; it is reported.

Evaluation texts with the same words equally often are one class, expanded at the end; of training texts each is looked
up and verified by itself where it is read, so neither can form a hot group, and no words of either side are shuffled. A
shard is at most SHARD_WORDS words of evaluation texts. Its index is built once, by one task, as a file of the shared
folder that workers map into their memory. A training text is cut into words and put in order once and then meets every
shard; nothing of either side is collected. The order of words is that of their counts in the first shard.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.functions.words import WordCodes, bag_tokens
from prosewright.llm.near_dup import Texts
from prosewright.session import shared_path, stored

WINDOW = 3
SHARD_WORDS = 9_000_000
#: Words of the training texts looked up at a time, and the pairs of places compared at once.
LOOKUP_WORDS, LOOKUP_ENTRIES = 4_000_000, 1 << 20
#: Candidates from which the training texts looked up at a time are halved, down to this many texts.
LOOKUP_PAIRS, LEAST_TEXTS = 1 << 22, 256
#: Pairs of places from which a word has a table of its own, and the training places a table holds at once.
TABLE_PAIRS, TABLE_ROWS = 1024, 64
#: Slots of the counts that order words, the most tasks that send them (4 MB each) to the driver, and bits of the sketches.
COUNTS, COUNTED, SKETCH_BITS = 1 << 20, 8, 256
#: Buckets of the token histograms that bound a pair's similarity from above.
BINS = 128


def letters(codes: np.ndarray) -> str:
    """One character for each word, of 19 bits of its code."""
    return ((codes.astype(np.uint32) & np.uint32((1 << 19) - 1)) + np.uint32(0x10000)).tobytes().decode("utf-32-le")


def histograms(t: Texts) -> np.ndarray:
    """texts x BINS: how many tokens of each text fall into each bucket. The sum of the lesser counts of two texts is at least what they have in common."""
    owner = np.repeat(np.arange(t.n), t.lengths)
    return np.bincount(owner * BINS + (t.tokens % np.uint64(BINS)).astype(np.int64), minlength=t.n * BINS).reshape(t.n, BINS).clip(max=65535).astype(np.uint16)


def may_reach(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, step: int = 1 << 15) -> np.ndarray:
    """Which pairs (i of a, j of b) can reach the threshold, by their histograms. Never false for one that does."""
    out = np.empty(len(i), bool)
    for s in range(0, len(i), step):
        p, q = i[s : s + step], j[s : s + step]
        common = np.minimum(a[p], b[q]).sum(axis=1, dtype=np.int64)
        out[s : s + step] = common >= threshold * (na[p] + nb[q] - common) - 1e-6
    return out


def _spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def sketches(bags: np.ndarray, n: np.ndarray, step: int = 8192) -> np.ndarray:
    """texts x (SKETCH_BITS / 64): parities of how many tokens fall to each bit. Two texts differ in at least as many tokens as their sketches in bits."""
    out, ends = np.empty((len(n), SKETCH_BITS // 64), np.uint64), np.append(0, np.cumsum(n))
    for s in range(0, len(n), step):
        k = len(n[s : s + step])
        at = np.repeat(np.arange(k), n[s : s + step]) * SKETCH_BITS + (bags[ends[s] : ends[s + k]] % np.uint32(SKETCH_BITS)).astype(np.int64)
        out[s : s + k] = np.packbits((np.bincount(at, minlength=k * SKETCH_BITS) & 1).astype(bool).reshape(k, SKETCH_BITS), axis=1).view(np.uint64)
    return out


def word_counts(bags: np.ndarray) -> np.ndarray:
    """How many tokens fall to each of COUNTS slots."""
    return np.bincount((bags % np.uint32(COUNTS)).astype(np.int64), minlength=COUNTS)


def ordered(bags: np.ndarray, n: np.ndarray, counts: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """The tokens of each text, rarest first by the counts of their slots (uint16), then by number."""
    out, ends = np.empty(len(bags), np.uint32), np.append(0, np.cumsum(n))
    for s in range(0, len(n), step):
        k = len(n[s : s + step])
        x = bags[ends[s] : ends[s + k]]
        both = (np.repeat(np.arange(k, dtype=np.uint64), n[s : s + step]) << np.uint64(48)) | (counts[x % np.uint32(COUNTS)].astype(np.uint64) << np.uint64(32)) | x
        both.sort()
        out[ends[s] : ends[s + k]] = both.astype(np.uint32)
    return out


def places(bags: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, greatest length of the other text) of each place to look at, of texts with their words in order."""
    k = n - np.ceil(threshold * n - 1e-6).astype(np.int64) + 1
    span, own = _spans(k), np.repeat(np.arange(len(n)), k)
    most = np.floor((n[own] - span) * ((1 + threshold) / threshold) - n[own] + 1e-6).clip(max=65535).astype(np.uint16)
    return own, bags[np.repeat(np.cumsum(n) - n, k) + span], most


class Lookup:
    """Places of training texts as every shard needs them: by word, then by greatest length of the other text. Lengths beyond 65535 are taken for equal."""

    def __init__(self, bags: np.ndarray, n: np.ndarray, threshold: float, counts: np.ndarray):
        own, word, most = places(ordered(bags, n, counts), n, threshold)
        order = np.argsort((word.astype(np.uint64) << np.uint64(32)) | most.astype(np.uint64))
        self.own, self.word, self.most = own[order], word[order], most[order]
        self.size, self.least = (x[self.own].clip(max=65535).astype(np.uint16) for x in (n, np.ceil(threshold * n - 1e-6)))
        self.sketch = sketches(bags, n)


class PrefixIndex:
    """Which evaluation texts may reach the threshold with a training text. Never without one that does.

    Words are put in one order, rarest first. If the first word common to two texts of n and m words is the i-th of one
    and the j-th of the other (from 0), they have at most n - i and m - j words in common, and need threshold / (1 +
    threshold) * (n + m). So each place of a word has a greatest length of the other text, beyond which it needn't be
    looked at; where that is under the least length the threshold allows, it isn't kept. The order may be any, as long as
    it is one: counts of a part of the texts do.

    A word's places in the training texts meet those in the evaluation texts as a table of comparisons, both sorted by
    length; sketches thin what passes.
    """

    ARRAYS = {"n": np.int64, "texts": np.int32, "words": np.uint32, "first": np.int64, "owner": np.int32, "longest": np.uint16, "size": np.uint16, "sketch": np.uint64}

    def __init__(self, bags: list[np.ndarray], threshold: float, step: int = 8192, counts: np.ndarray | None = None):
        flat, n = np.concatenate(bags) if bags else np.empty(0, np.uint32), np.array([len(x) for x in bags], np.int64)
        self.threshold, self.n = threshold, n
        self.counts = word_counts(flat).clip(max=65535).astype(np.uint16) if counts is None else counts
        self.texts = np.argsort(n, kind="stable").astype(np.int32)  # entries name texts by their place in this order
        place = np.empty(len(n), np.int32)
        place[self.texts] = np.arange(len(n), dtype=np.int32)
        ends = np.append(0, np.cumsum(n))
        word, owner, longest = [np.empty(0, np.uint32)], [np.empty(0, np.int32)], [np.empty(0, np.uint16)]
        for s in range(0, len(n), step):
            k = n[s : s + step]
            own, w, most = places(ordered(flat[ends[s] : ends[s + len(k)]], k, self.counts), k, threshold)
            word.append(w), owner.append(place[s + own]), longest.append(most)
        word, owner, longest = np.concatenate(word), np.concatenate(owner), np.concatenate(longest)
        order = np.argsort((word.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64))
        self.words, first = np.unique(word[order], return_index=True)
        self.first, self.owner, self.longest = np.append(first, len(word)), owner[order], longest[order]
        self.size = n[self.texts[self.owner]].clip(max=65535).astype(np.uint16)
        self.sketch = sketches(flat, n)[self.texts]

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.ascontiguousarray(getattr(self, k), kind) for k, kind in self.ARRAYS.items()}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], threshold: float, counts: np.ndarray) -> PrefixIndex:
        out = cls.__new__(cls)
        out.threshold, out.counts = threshold, counts
        for k in cls.ARRAYS:
            setattr(out, k, arrays[k])
        return out

    def _tables(self, word: np.ndarray):
        """(from, to) in the training places, sorted by word, and (from, to) in the entries, of each word in both."""
        a = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        at = np.minimum(np.searchsorted(self.words, word[a]), len(self.words) - 1)
        ok = self.words[at] == word[a]
        return a[ok], np.append(a[1:], len(word))[ok], self.first[at[ok]], self.first[at[ok] + 1]

    def candidates(self, bags: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training text, evaluation text) by number, in this order; bags holds the words of the training texts of n words one after the other."""
        pairs = self.meet(Lookup(bags, n, self.threshold, self.counts))
        return pairs // max(1, len(self.n)), pairs % max(1, len(self.n))

    def meet(self, look: Lookup, limit: float = np.inf) -> np.ndarray | None:
        """Candidates as training text * evaluation texts + evaluation text, in this order; None if there are more than `limit`."""
        if not len(self.owner) or not len(look.own):
            return np.empty(0, np.int64)
        own, word, most, size, least, sketch = look.own, look.word, look.most, look.size, look.least, look.sketch
        times = np.uint32(0x01010101)
        bound = np.floor((1 - self.threshold) / (1 + self.threshold) * np.arange(2 * 65535 + 1) + 1e-6)  # differing tokens of two texts, by the words of both
        a, b, c, d = self._tables(word)
        many = (b - a) * (d - c)
        out, more = [np.empty(0, np.int64)], 0

        def keep(i, e):
            nonlocal out, more
            t, v = own[i], self.owner[e]
            x = sketch.take(t, axis=0)
            x ^= self.sketch.take(v, axis=0)
            apart = (np.bitwise_count(x).view(np.uint32).ravel() * times) >> np.uint32(24)  # the four counts summed; 256 counts as 0, which passes
            ok = apart <= bound.take(size.take(i).astype(np.int32) + self.size.take(e))
            ok |= size.take(i) == 65535
            out.append(t[ok] * len(self.n) + self.texts[v[ok]])
            more += len(out[-1])
            if more > LOOKUP_ENTRIES:  # a pair may pass at several places
                out, more = [np.unique(np.concatenate(out))], 0
            return len(out[0]) <= limit

        few = many <= TABLE_PAIRS
        x, y, c1, m = a[few], (b - a)[few], c[few], (d - c)[few]
        wide = np.repeat(m, y)  # of each training place: entries of its word
        row, start = np.repeat(x, y) + _spans(y), np.repeat(c1, y)
        block = np.cumsum(wide) // LOOKUP_ENTRIES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(wide)]
        for s, t in zip(cuts, cuts[1:]):
            i, e = np.repeat(row[s:t], wide[s:t]), np.repeat(start[s:t], wide[s:t]) + _spans(wide[s:t])
            ok = (self.size[e] >= least[i]) & (self.size[e] <= most[i]) & (self.longest[e] >= size[i])
            if not keep(i[ok], e[ok]):
                return None
        i_, e_, held = [], [], 0
        for x, y, c1, d1 in zip(a[~few].tolist(), b[~few].tolist(), c[~few].tolist(), d[~few].tolist()):
            for s in range(x, y, TABLE_ROWS):
                t = min(y, s + TABLE_ROWS)
                lo, hi = c1 + self.size[c1:d1].searchsorted(least[s:t].min()), c1 + self.size[c1:d1].searchsorted(most[t - 1], "right")
                for p in range(lo, hi, wide_ := max(1, LOOKUP_ENTRIES // TABLE_ROWS)):
                    q = min(hi, p + wide_)
                    ok = self.longest[p:q] >= size[s:t, None]
                    ok &= self.size[p:q] <= most[s:t, None]
                    ok &= self.size[p:q] >= least[s:t, None]
                    at = np.flatnonzero(ok)
                    if len(at):
                        r = at // (q - p)
                        i_.append(s + r), e_.append(p + at - r * (q - p))
                        held += len(at)
                    if held > LOOKUP_ENTRIES // 4:
                        if not keep(np.concatenate(i_), np.concatenate(e_)):
                            return None
                        i_, e_, held = [], [], 0
        if held:
            keep(np.concatenate(i_), np.concatenate(e_))
        pairs = np.unique(np.concatenate(out))
        return pairs if len(pairs) <= limit else None


def _system(path: str):
    """(file system, path in it) of a path of the shared folder, inside a worker."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shared_table(path: str, columns: list[str]) -> pa.Table:
    """A Parquet table of the shared folder, read inside a worker."""
    import pyarrow.dataset as ds

    system, inner = _system(path)
    return ds.dataset(inner, filesystem=system, format="parquet").to_table(columns=columns)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    system, inner = _system(path)
    system.create_dir(inner.rpartition("/")[0])
    t = pa.table({k: pa.array([np.ascontiguousarray(x).data.cast("B") if x.size else b""], pa.large_binary()) for k, x in arrays.items()})
    with system.open_output_stream(inner) as out, pa.ipc.new_file(out, t.schema) as w:
        w.write_table(t)


def read_arrays(path: str, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """What `write_arrays` has written; a local file is mapped, so all workers of a machine share its memory."""
    import pyarrow.fs as fs

    system, inner = _system(path)
    with pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner) as f:
        t = pa.ipc.open_file(f if isinstance(f, pa.MemoryMappedFile) else pa.BufferReader(f.read_buffer())).read_all()
        return {k: np.frombuffer(t.column(k)[0].as_buffer(), kind) for k, kind in kinds.items()}


class _Coded(Texts):
    """Token sets of texts given as word codes."""

    def __init__(self, batch: list[bytes]):
        self.n = len(batch)
        self.rows = np.arange(self.n)
        self.lengths = np.array([len(x) // 4 for x in batch], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = np.frombuffer(b"".join(batch), np.uint32)
        self.tokens = bag_tokens(self.codes, self.starts)


def _evaluations(min_words: int, shards: int):
    """(shard, id, class, word codes) of the evaluation texts; the codes only once for a class of a batch."""

    def run(batches):
        codes = WordCodes()
        for b in batches:
            t = Texts(b.column(1).to_pylist(), codes, min_words)
            cls = t.classes()
            first = np.zeros(t.n, bool)
            first[np.unique(cls, return_index=True)[1]] = True
            words_ = [t.codes[a : a + n].tobytes() if f else None for a, n, f in zip(t.starts.tolist(), t.lengths.tolist(), first.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array((cls % shards).astype(np.int32)), b.column(0).take(pa.array(t.rows)), pa.array(cls), pa.array(words_, pa.binary())], names=["shard", "id", "cls", "codes"])

    return run


def _bags(t: Texts) -> np.ndarray:
    return (t.tokens >> np.uint64(32)).astype(np.uint32)


def _counted(batches):
    """Counts of the slots of words, one row a task."""
    out = np.zeros(COUNTS, np.uint32)
    for b in batches:
        out += word_counts(_bags(_Coded(b.column(0).drop_null().to_pylist()))).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])


class _Shard:
    """The evaluation texts of one shard: words, token sets and the prefix index. Built once, then read from the shared folder."""

    ARRAYS = {"cls": np.int64, "codes": np.uint32, "first": np.int64, "bags": np.uint32, "histogram": np.uint16}

    def __init__(self, file: str, threshold: float, counts: np.ndarray):
        x = read_arrays(file, self.ARRAYS | {f"index_{k}": v for k, v in PrefixIndex.ARRAYS.items()})
        for k in self.ARRAYS:
            setattr(self, k, x[k])
        self.histogram = self.histogram.reshape(-1, BINS)
        self.index = PrefixIndex.of({k: x[f"index_{k}"] for k in PrefixIndex.ARRAYS}, threshold, counts)
        self.index.sketch = self.index.sketch.reshape(-1, SKETCH_BITS // 64)
        self.n = self.index.n

    @classmethod
    def build(cls, path: str, shard: int, file: str, threshold: float, counts: np.ndarray) -> None:
        t = shared_table(f"{path}/shard={shard}", ["cls", "codes"])
        t = t.filter(t.column("codes").is_valid())
        of, one = np.unique(t.column("cls").to_numpy(), return_index=True)  # copies may come from several batches
        t = _Coded(t.column("codes").take(pa.array(one)).to_pylist())
        bags = _bags(t)
        index = PrefixIndex([bags[a : a + n] for a, n in zip(t.starts.tolist(), t.lengths.tolist())], threshold, counts=counts)
        own = {"cls": of, "codes": t.codes, "first": np.append(t.starts, len(t.codes)), "bags": bags, "histogram": histograms(t)}
        write_arrays(file, {k: x.astype(cls.ARRAYS[k], copy=False) for k, x in own.items()} | {f"index_{k}": x for k, x in index.arrays().items()})


def _built(path: str, there: list[int], threshold: float, counts):
    """(shard, file) of each shard, once its file is written; a task that is run again writes another file."""

    def run(batches):
        order = np.frombuffer(counts.value, np.uint16)
        for b in batches:
            files = [f"{path}-shards/{uuid.uuid4().hex}" for _ in range(b.num_rows)]
            for k, file in zip(b.column(0).to_pylist(), files):
                _Shard.build(path, there[k], file, threshold, order)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files)], names=["shard", "file"])

    return run


_SHARD: dict[tuple[str, float], _Shard] = {}


def _shard(file: str, threshold: float, counts: np.ndarray) -> _Shard:
    """The worker's shard; only the last one used is kept."""
    if (file, threshold) not in _SHARD:
        _SHARD.clear()
        _SHARD[file, threshold] = _Shard(file, threshold, counts)
    return _SHARD[file, threshold]


def _near(s: _Shard, t: Texts, short: np.ndarray, of_train: np.ndarray, look: Lookup, threshold: float, counts: np.ndarray):
    """(training text, evaluation text) that may reach the threshold, in this order; in several parts where there are many."""
    ends = np.append(t.starts, len(short))
    todo = [(0, t.n, look)]
    while todo:
        k, end, look = todo.pop()
        look = look or Lookup(short[ends[k] : ends[end]], t.lengths[k:end], threshold, counts)
        pairs = s.index.meet(look, LOOKUP_PAIRS if end - k > LEAST_TEXTS else np.inf)
        if pairs is None:
            half = (k + end) // 2
            todo += [(half, end, None), (k, half, None)]
            continue
        i, j = k + pairs // len(s.n), pairs % len(s.n)
        ok = may_reach(of_train, s.histogram, i, j, t.lengths, s.n, threshold)
        yield i[ok], j[ok]


def _similar(s: _Shard, t: Texts, short: np.ndarray, own: np.ndarray, ev: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs reach the threshold, their similarity), exactly."""
    keep, sims = [], []
    for i, (x, y) in enumerate(zip(own.tolist(), ev.tolist())):
        a, b = short[t.starts[x] : t.starts[x] + t.lengths[x]], s.bags[s.first[y] : s.first[y + 1]]
        both = len(np.intersect1d(a, b))
        if (sim := both / (len(a) + len(b) - both)) >= threshold - 1e-9:
            keep.append(i), sims.append(sim)
    return np.array(keep, np.int64), np.array(sims, float)


def _coverage(s: _Shard, t: Texts, txt: np.ndarray, ev: np.ndarray) -> np.ndarray:
    """Share of the evaluation text that the passages found in the training text cover, of each pair; pairs are sorted.

    One automaton holds all passages of the evaluation texts of these pairs, so it is as large as the pairs of a batch make it.
    """
    import ahocorasick

    mates = np.unique(ev)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    number: dict[str, int] = {}
    holders: list[list[tuple[int, int]]] = []  # of each passage: (evaluation text, place)
    for k in mates.tolist():
        line = letters(s.codes[s.first[k] : s.first[k + 1]])
        for at in range(len(line) - WINDOW + 1):
            p = line[at : at + WINDOW]
            i = number.setdefault(p, len(holders))
            if i == len(holders):
                automaton.add_word(p, i)
                holders.append([])
            holders[i].append((k, at))
    automaton.make_automaton()
    cover = np.zeros(len(txt))
    bounds = np.flatnonzero(np.append(True, txt[1:] != txt[:-1]))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(txt)]):
        mine = {k: np.zeros(s.n[k], bool) for k in ev[a:b].tolist()}
        start = int(t.starts[txt[a]])
        for i in {p for _, p in automaton.iter(letters(t.codes[start : start + int(t.lengths[txt[a]])]))}:
            for k, at in holders[i]:
                if k in mine:
                    mine[k][at : at + WINDOW] = True
        cover[a:b] = [mine[k].mean() for k in ev[a:b].tolist()]
    return cover


def _held(batches, limit: int):
    """Tables of batches, of about `limit` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scan(files: list[str], threshold: float, min_words: int, counts):
    """Each training text is cut into words and put in order once, then meets one shard after the other."""

    def run(batches):
        codes, order = WordCodes(), np.frombuffer(counts.value, np.uint16)
        for b in _held(batches, 6 * LOOKUP_WORDS):
            t = Texts(b.column(1).to_pylist(), codes, min_words)
            if not t.n:
                continue
            short, of_train = _bags(t), histograms(t)
            look = Lookup(short, t.lengths, threshold, order)
            for file in files:
                s = _shard(file, threshold, order)
                for own, ev in _near(s, t, short, of_train, look, threshold, order):
                    keep, sims = _similar(s, t, short, own, ev, threshold)
                    if not len(keep):
                        continue
                    own, ev = own[keep], ev[keep]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t.rows[own])).combine_chunks(), pa.array(s.cls[ev]), pa.array(_coverage(s, t, own, ev)), pa.array(sims)], names=["id", "cls", "coverage", "similarity"])

    return run


def cross_split_overlaps(evals: DataFrame, train: DataFrame, eval_id: str = "sample_id", train_id: str = "row_id", threshold: float = 0.7, min_words: int = 40) -> DataFrame:
    """(eval_id, train_id, coverage, similarity): pairs of near-same texts of the two tables.

    Null, empty and short texts are in no pair. coverage is the share of the evaluation text's words that lie in passages
    the training text holds: 1 for a copy, 0 where no passage is intact. An empty table on either side gives no pair.
    """
    spark = evals.sparkSession
    e = evals.where(F.col("text").isNotNull() & F.col(eval_id).isNotNull())
    g = train.where(F.col("text").isNotNull() & F.col(train_id).isNotNull()).select(train_id, "text")
    eid, gid = dict(evals.dtypes)[eval_id], dict(train.dtypes)[train_id]
    chars = e.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // (6 * SHARD_WORDS)))
    path = shared_path(spark, "evaluations")
    e.select(eval_id, "text").mapInArrow(_evaluations(min_words, shards), f"shard int, id {eid}, cls long, codes binary").write.partitionBy("shard").parquet(path)
    members = spark.read.schema(f"id {eid}, cls long, codes binary, shard int").parquet(path)
    there = sorted(r[0] for r in members.select("shard").distinct().collect())
    near = spark.createDataFrame([], f"id {gid}, cls long, coverage double, similarity double")
    if there:
        parts = members.where(F.col("shard") == there[0]).select("codes").coalesce(COUNTED).mapInArrow(_counted, "counts binary").collect()
        counts = spark.sparkContext.broadcast(sum(np.frombuffer(r[0], np.uint32).astype(np.int64) for r in parts).clip(max=65535).astype(np.uint16).tobytes())
        built = spark.range(0, len(there), 1, len(there)).mapInArrow(_built(path, there, threshold, counts), "shard long, file string").collect()
        near = g.mapInArrow(_scan([r["file"] for r in sorted(built)], threshold, min_words, counts), near.schema)
    out = stored(near, "overlaps").join(members.select(F.col("id").alias("e_id"), "cls"), "cls")
    return out.select(F.col("e_id").alias(eval_id), F.col("id").alias(train_id), F.round("coverage", 6).alias("coverage"), "similarity").distinct()


def overlap_report(pairs: DataFrame, evals: DataFrame, train: DataFrame, eval_id: str = "sample_id", train_id: str = "row_id") -> DataFrame:
    """Per evaluation split and training source: pairs, evaluation records and training records touched."""
    p = pairs.join(evals.select(eval_id, "split"), eval_id).join(train.select(train_id, "source"), train_id)
    return p.groupBy("split", "source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(eval_id).alias("eval_records"), F.countDistinct(train_id).alias("train_records"))
