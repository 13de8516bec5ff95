"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Text is escaped as the model asks (spaces become U+2581, one is put in front) and
cut where such a mark follows another character; no piece of the model reaches over
such a place, so distinct words are encoded once.  Words of equal length advance
together: at each end, the hashes of all substrings up to the longest piece probe
the sorted hashes of the pieces, the best last piece is kept, and its length is the
backpointer.

- ``unigram`` models: the best is the greatest sum of scores, ties going to the
  longer last piece; a character without a piece costs the least score less ``UNKNOWN``.
- ``merges`` models (the one at ``MODEL``): a segmentation is the merge procedure's if
  no merge was due across any of its joints, so a path scores 0 or minus infinity, and
  each end has one last piece that agrees with the piece before it.  Whether two
  pieces agree is found by undoing their merges in turn, all pairs together, and is
  remembered.  Maximal sums of scores would give other ids than the model's own.

Characters without a piece become the byte pieces of their UTF-8.  Decoding joins
the pieces' bytes, turns the marks back to spaces and drops the first.

Cases: a null or empty text has no pieces and decodes to an empty text; U+2581 in a
text decodes as a space, as the model can't tell them apart; repeated rows get equal
ids; an empty table gives none; texts may have any length: runs of spaces take a few
steps, a word without spaces takes time in proportion to its length.  Columns that are
not read may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.textvec import BASE, BASE_INVERSE, _power, chunks, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
KIND = "merges"
UNKNOWN = 10.0
#: A worker keeps the pieces of words, and the agreement of pairs of pieces, in tables of
#: ``2**CACHE_BITS`` places that a hash decides; a newcomer takes the place of what is there.
CACHE_BITS = 20
#: Ids that are kept; beyond, the words' table starts anew.
CACHE_IDS = 3_000_000
#: Bits of the filter before the probes.
FILTER_BITS = 22
#: Ids that are decoded at once; a longer text is decoded alone.
DECODED = 1 << 19
#: Runs of marks up to this length are remembered.
MARKS_KEPT = 4096
#: Cells (words x ends x lengths) that are worked on at once.
CELLS = 1 << 22


def _hashes(codes: np.ndarray) -> np.ndarray:
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.multiply(codes.astype(np.uint64) + np.uint64(1), _power(BASE, len(codes))[:len(codes)], out=total[1:])
    return np.cumsum(total, out=total)


class Pieces:
    """The model's pieces as sorted hashes, and their bytes."""

    def __init__(self, path: str = MODEL, kind: str = KIND):
        import sentencepiece

        self.kind = kind

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not (byte[i] or model.is_control(i) or model.is_unknown(i))]
        if any(chr(MARK) in names[i].lstrip(chr(MARK)) for i in normal):
            raise ValueError("a piece of this model reaches over a word's start")
        codes = [np.frombuffer(names[i].encode("utf-32-le"), "<u4") for i in normal]
        key = np.array([mixed(_hashes(c)[-1:])[0] for c in codes], np.uint64)
        order = np.argsort(key)
        self.key, self.id = key[order], np.array(normal, np.int32)[order]
        self.score = np.array([model.get_score(i) for i in normal], np.float64)[order]
        self.size = np.array(list(map(len, codes)), np.int64)[order]
        self.plain = np.array([_hashes(c)[-1] for c in codes], np.uint64)[order]
        if kind == "merges":
            self._learn_merges([names[i] for i in normal], [model.get_score(i) for i in normal], order)
        self.longest = max(map(len, codes))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.key >> np.uint64(64 - FILTER_BITS)] = True
        self.unknown_score = self.score.min() - UNKNOWN
        self.byte_id = np.full(256, model.unk_id(), np.int32)
        for i in range(n):
            if byte[i]:
                self.byte_id[int(names[i][3:5], 16)] = i
        raw = [bytes([int(x[3:5], 16)]) if byte[i] else b"" if model.is_control(i) else x.replace(chr(MARK), " ").encode("utf-8") for i, x in enumerate(names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def _learn_merges(self, names: list[str], scores: list[float], order: np.ndarray) -> None:
        """The merge that makes each piece, in the order in which merges happen; pieces that no merges make are never used."""
        score = dict(zip(names, scores))
        marks = {x for x in names if len(x) > 1 and set(x) == {chr(MARK)}}
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        where = {x: int(place[i]) for i, x in enumerate(names)}
        left, right = np.full(len(names), -1, np.int64), np.full(len(names), -1, np.int64)
        made = np.zeros(len(names), bool)
        for x in names:
            parts, last = list(x), None
            while len(parts) > 1 and x not in marks:
                due = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score and a + b not in marks]
                if not due:
                    break
                i = min(due)[1]
                last = (parts[i], parts[i + 1])
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            at = where[x]
            made[at] = len(parts) == 1 and x not in marks
            if made[at] and last:
                left[at], right[at] = where[last[0]], where[last[1]]
        # single characters are there from the start, in any order; then merges by score
        rank = np.empty(len(names), np.int64)
        by = sorted(range(len(names)), key=lambda i: (len(names[i]) > 1, -score[names[i]], names[i]))
        rank[place[by]] = np.arange(len(names))
        self.left, self.right, self.made, self.rank = left, right, made, rank
        self.mark = where.get(chr(MARK), -1)
        self.mark_runs: dict[int, np.ndarray] = {}
        self.mark_names = {x: int(self.id[where[x]]) for x in marks | {chr(MARK)}}
        self.mark_score = {x: score[x] for x in marks | {chr(MARK)} if x in score}

    def _run_of_marks(self, n: int) -> np.ndarray:
        """Ids of n marks in a row, by the merge procedure (greatest score first, then leftmost).

        Pieces of equal size stand in runs, so a step goes through few of them; a run merges as a whole
        where none of the new neighbours would go before the rest of it.
        """
        if n not in self.mark_runs:
            score, least = {len(x): v for x, v in self.mark_score.items() if len(x) > 1}, -np.inf
            runs = [[1, n]]
            while True:
                due = [(-score[2 * s], r, 0) for r, (s, c) in enumerate(runs) if c > 1 and 2 * s in score]
                due += [(-score[a[0] + b[0]], r, 1) for r, (a, b) in enumerate(zip(runs, runs[1:])) if a[0] + b[0] in score]
                if not due:
                    break
                _, r, beside = min(due)
                size, count = runs[r]
                if beside:
                    other, more = runs[r + 1]
                    runs[r:r + 2] = [[size, count - 1], [size + other, 1], [other, more - 1]]
                else:
                    new = 2 * size
                    near = [new + size, new + new, *(new + runs[i][0] for i in (r - 1, r + 1) if 0 <= i < len(runs))]
                    all_at_once = all(score.get(x, least) < score[new] for x in near)
                    runs[r:r + 1] = [[new, count // 2], [size, count % 2]] if all_at_once else [[new, 1], [size, count - 2]]
                joined = []
                for s, c in runs:
                    if c and joined and joined[-1][0] == s:
                        joined[-1][1] += c
                    elif c:
                        joined.append([s, c])
                runs = joined
            one = chr(MARK)
            ids = np.repeat([self.mark_names[one * s] for s, _ in runs], [c for _, c in runs]).astype(np.int32)
            if n > MARKS_KEPT:
                return ids
            self.mark_runs[n] = ids
        return self.mark_runs[n]

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b make together; a rank over all if there is none."""
        h = mixed(self.plain[a] + self.plain[b] * _power(BASE, 64)[self.size[a]])
        at, known = self._probe(h)
        return np.where(known & self.made[at], self.rank[at], len(self.key))

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Would the merge procedure leave pieces a and b side by side?"""
        out = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), len(self.key))
        while len(live):
            due = self._joined(a, b) < limit
            out[live[due]] = False
            live, a, b, limit = live[~due], a[~due], b[~due], limit[~due]
            ra, rb = np.where(self.right[a] >= 0, self.rank[a], -1), np.where(self.left[b] >= 0, self.rank[b], -1)
            # the later of the two last merges is undone; where neither can be, the pair stands
            undo_a, undo_b = (ra > rb) & (ra >= 0), (rb >= ra) & (rb >= 0)
            limit = np.where(undo_a, ra, np.where(undo_b, rb + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            more = undo_a | undo_b
            live, a, b, limit = live[more], a[more], b[more], limit[more]
        return out

    def _agree(self, a: np.ndarray, b: np.ndarray, memo: dict) -> np.ndarray:
        """``agree``, remembered."""
        if not memo:
            memo.update(pair=np.full(1 << CACHE_BITS, -1, np.int64), stands=np.zeros(1 << CACHE_BITS, bool))
        pair = (a << 32) | b
        slot = mixed(pair.view(np.uint64)) >> np.uint64(64 - CACHE_BITS)
        stands = memo["stands"][slot]
        new = np.flatnonzero(memo["pair"][slot] != pair)
        if len(new):
            stands[new] = self.agree(a[new], b[new])
            # key and value of a place go together: of several newcomers the last one has both
            memo["pair"][slot[new]] = pair[new]
            won = new[memo["pair"][slot[new]] == pair[new]]
            memo["stands"][slot[won]] = stands[won]
        return stands

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the sorted pieces, and whether the hash is there."""
        at, known = np.zeros(h.shape, np.int64), self.filter[h >> np.uint64(64 - FILTER_BITS)]
        some = h[known]
        place = np.minimum(np.searchsorted(self.key, some), len(self.key) - 1)
        at[known] = place
        known[known] = self.key[place] == some
        return at, known

    # ---- encoding

    def words(self, codes: np.ndarray, total: np.ndarray, start: np.ndarray, size: np.ndarray, memo: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words codes[start:start + size] one after another, and their numbers."""
        all_ids, all_owner = [], []
        for length in np.unique(size[size > 0]):
            same = np.flatnonzero(size == length)
            step = max(1, CELLS // (int(length) * self.longest))
            for at in range(0, len(same), step):
                ids, owner = self._equal(codes, total, start[same[at:at + step]], int(length), memo)
                all_ids.append(ids)
                all_owner.append(same[at:at + step][owner])
        if not all_ids:
            return np.zeros(0, np.int32), np.zeros(len(start), np.int64)
        ids, owner = np.concatenate(all_ids), np.concatenate(all_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(start))

    def _marked(self, codes, total, start, size, memo):
        """``words``, with runs of marks in front of a word encoded on their own."""
        if self.kind == "unigram":
            return self.words(codes, total, start, size, memo)
        other = np.append(np.flatnonzero(codes != MARK), len(codes))
        lead = np.minimum(other[np.searchsorted(other, start)] - start, size)
        skip = np.where(lead == size, size, np.maximum(lead - 1, 0))
        ids, n = self.words(codes, total, start + skip, size - skip, memo)
        runs = np.flatnonzero(skip)
        if not len(runs):
            return ids, n
        ends = np.cumsum(n)
        parts, at = [], 0
        numbers = n.copy()
        for i in runs:
            first = ends[i] - n[i]
            parts.append(ids[at:first])
            alone = n[i] > 0 and self.mark >= 0 and ids[first] == self.id[self.mark]
            run = self._run_of_marks(int(skip[i]) + int(alone))
            parts.append(run)
            at = first + int(alone)
            numbers[i] += len(run) - int(alone)
        return np.concatenate([*parts, ids[at:]]).astype(np.int32), numbers

    def _equal(self, codes: np.ndarray, total: np.ndarray, start: np.ndarray, length: int, memo: dict) -> tuple[np.ndarray, np.ndarray]:
        n = len(start)
        best = np.zeros((n, length + 1)) if self.kind == "unigram" else None
        # the last piece before each place: -1 for none or one without a piece, which agree with all
        state = np.full((n, length + 1), -1, np.int64)
        back, piece = np.zeros((n, length + 1), np.int16), np.zeros((n, length + 1), np.int32)
        row = np.arange(n)
        inverse = _power(BASE_INVERSE, len(codes) + 1)
        for end in range(1, length + 1):
            lengths = np.arange(min(end, self.longest), 0, -1)
            begin = start[:, None] + end - lengths
            h = mixed((total[start + end][:, None] - total[begin]) * inverse[begin])
            at, known = self._probe(h)
            if self.kind == "unigram":
                value = np.where(known, self.score[at], -np.inf)
                value[~known[:, -1], -1] = self.unknown_score
                value += best[:, end - lengths]
                choice = value.argmax(axis=1)
                best[:, end] = value[row, choice]
            else:
                value = known & self.made[at]
                before = state[:, end - lengths]
                i, j = np.nonzero(value & (before >= 0))
                value[i, j] = self._agree(before[i, j], at[i, j], memo)
                value[:, -1] |= ~known[:, -1]
                choice = value.argmax(axis=1)
                state[:, end] = np.where(known[row, choice], at[row, choice], -1)
            back[:, end] = lengths[choice]
            piece[:, end] = np.where(known[row, choice], self.id[at[row, choice]], -1)
        # walk back, all words together
        end, owner, ids, ends = np.full(n, length), [], [], []
        live = np.arange(n)
        while len(live):
            e = end[live]
            owner.append(live)
            ids.append(piece[live, e])
            ends.append(e)
            end[live] = e - back[live, e]
            live = live[end[live] > 0]
        owner, ids, ends = np.concatenate(owner), np.concatenate(ids), np.concatenate(ends)
        order = np.lexsort((ends, owner))
        owner, ids, ends = owner[order], ids[order], ends[order]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            parts = [np.frombuffer(chr(codes[start[owner[i]] + ends[i] - 1]).encode("utf-8"), np.uint8) for i in unknown]
            times = np.ones(len(ids), np.int64)
            times[unknown] = [len(p) for p in parts]
            hole = np.repeat(ids < 0, times)
            owner, ids = np.repeat(owner, times), np.repeat(ids, times)
            ids[hole] = self.byte_id[np.concatenate(parts)]
        return ids, owner

    def encode(self, texts: pa.Array, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their numbers; ``cache`` keeps words' pieces."""
        out, numbers = [], []
        for _, data, offsets in chunks(texts):
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            some = np.flatnonzero(np.diff(at))
            codes = np.insert(np.where(codes == 0x20, MARK, codes), at[some], MARK)
            first = at[some] + np.arange(len(some))
            doc_starts = np.zeros(len(codes) + 1, bool)
            doc_starts[first] = True
            mark = codes == MARK
            begins = doc_starts[:-1].copy()
            begins[1:] |= mark[1:] & ~mark[:-1]
            start = np.flatnonzero(begins)
            size = np.diff(np.append(start, len(codes)))
            total = _hashes(codes)
            h = mixed((total[start + size] - total[start]) * _power(BASE_INVERSE, len(codes) + 1)[start])
            h, one, back = np.unique(h, return_index=True, return_inverse=True)
            place, count, flat = self._cached(h, codes, total, start[one], size[one], cache)
            n = count[back]
            ends = np.cumsum(n)
            total_ids = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.arange(total_ids) - np.repeat(ends - n, n) + np.repeat(place[back], n)])
            doc = np.searchsorted(first, start, "right") - 1
            per = np.zeros(len(offsets) - 1, np.int64)
            per[some] = np.bincount(doc, weights=n, minlength=len(some)).astype(np.int64) if len(some) else 0
            numbers.append(per)
        return np.concatenate([np.zeros(0, np.int32), *out]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *numbers])

    def _cached(self, h, codes, total, start, size, cache):
        if not cache or len(cache["flat"]) > CACHE_IDS:
            cache.update(key=np.zeros(1 << CACHE_BITS, np.uint64), place=np.zeros(1 << CACHE_BITS, np.int64),
                         count=np.zeros(1 << CACHE_BITS, np.int32), flat=np.zeros(0, np.int32), memo=cache.get("memo", {}))
        slot = h >> np.uint64(64 - CACHE_BITS)
        place, count = cache["place"][slot], cache["count"][slot].astype(np.int64)
        new = np.flatnonzero(cache["key"][slot] != h)
        if len(new):
            ids, n = self._marked(codes, total, start[new], size[new], cache["memo"])
            place[new], count[new] = len(cache["flat"]) + np.cumsum(n) - n, n
            cache["flat"] = np.concatenate([cache["flat"], ids])
            cache["key"][slot[new]] = h[new]
            won = new[cache["key"][slot[new]] == h[new]]
            cache["place"][slot[won]], cache["count"][slot[won]] = place[won], count[won]
        return place, count, cache["flat"]

    # ---- decoding

    def decode(self, ids: np.ndarray, numbers: np.ndarray) -> pa.Array:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
        if not len(numbers):
            return pa.array([], pa.string())
        ends, out, first = np.cumsum(numbers), [], 0
        while first < len(numbers):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + DECODED, "right")))
            out.append(self._texts(ids[before:int(ends[last - 1])], numbers[first:last]))
            first = last
        return pa.concat_arrays(out)

    def _texts(self, ids: np.ndarray, numbers: np.ndarray) -> pa.Array:
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        data = self.raw[np.arange(n) + np.repeat(self.raw_start[ids] - ends + size, size)]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(numbers)])]
        some = np.diff(cut) > 0
        lead = cut[:-1][some]
        lead = lead[data[lead] == 0x20]
        keep = np.ones(n, bool)
        keep[lead] = False
        offsets = np.concatenate([[0], np.cumsum(keep)])[cut]
        data = data[keep].tobytes()
        try:
            data.decode("utf-8")
            whole = pa.Array.from_buffers(pa.large_string(), len(numbers), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            return whole.cast(pa.string())
        except UnicodeDecodeError:
            return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())


def _lists(ids: np.ndarray, numbers: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)), pa.array(ids))


def encoded(docs: DataFrame, path: str = MODEL, name: str = "ids", kind: str = KIND) -> DataFrame:
    """``docs`` with the ids of the text's pieces in column ``name`` (replaced if there is one)."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(Pieces(path, kind)), {}

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        return _lists(*shared.value.encode(text, kept))

    return docs.withColumn(name, encode(F.col("text")))


def decoded(rows: DataFrame, path: str = MODEL, ids: str = "ids", name: str = "text") -> DataFrame:
    """``rows`` with the text of column ``ids`` in column ``name`` (replaced if there is one)."""
    shared = rows.sparkSession.sparkContext.broadcast(Pieces(path))

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.int32()))
        numbers = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
        return shared.value.decode(np.asarray(lists.flatten()), numbers)

    return rows.withColumn(name, decode(F.col(ids)))


def digest(docs: DataFrame, path: str = MODEL, kind: str = KIND) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding them gives the text back (encoded and decoded in one UDF)."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(Pieces(path, kind)), {}

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def there_and_back(text: pa.Array) -> pa.Array:
        ids, numbers = shared.value.encode(text, kept)
        given = pc.replace_substring(pc.fill_null(text.cast(pa.string()), ""), chr(MARK), " ")
        same = pc.equal(shared.value.decode(ids, numbers), given)
        return pa.StructArray.from_arrays([_lists(ids, numbers), same], ["ids", "round_trip"])

    rows = docs.select("doc_id", there_and_back("text").alias("p"))
    return rows.select("doc_id", F.size("p.ids").cast("long").alias("n_tokens"), "p.ids", "p.round_trip")
