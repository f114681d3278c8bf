"""Operators on texts against brute-force versions that know nothing of batches, hashes or parts."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
import regex

from tests.llm.conftest import frame
from tidemark.llm import chunks, decontaminate, lines, minhash, packing, slots, substrings

BLANK = regex.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def key(i):
    return float("inf") if i is None else i


def plain_chunks(raw):
    h, ends, last = 0, [], None
    for i, b in enumerate(raw):
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        e = i + 1
        if not h & int(chunks.MASK) and 16 <= e < len(raw) and raw[e] & 0xC0 != 0x80:
            if last is None or e - last >= 16:
                ends.append(e)
            last = e
    out, start = [], 0
    for e in [*ends, len(raw)]:
        at = start
        while e - at > 256:
            cut = start + 256 * ((at - start) // 256 + 1)
            begin, at = at, cut
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append((begin, cut))
            if cut != at:
                out[-1] = (begin, cut)
            at = cut if cut == at else at
        if e > at:
            out.append((at, e))
        start = e
    fixed, begin = [], 0
    for _, e in out:
        while e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        fixed.append((begin, e))
        begin = e
    return fixed


def test_chunks_equal_a_sequential_gear(spark, docs, rows):
    split = [(i, (t or "").encode(), plain_chunks((t or "").encode())) for i, t in rows]
    least = {}
    for i, raw, cut in split:
        for a, b in cut:
            least[raw[a:b]] = min(least.get(raw[a:b], float("inf")), key(i))
    want = []
    for i, raw, cut in split:
        seen, spans = set(), []
        for a, b in cut:
            late = key(i) > least[raw[a:b]] or raw[a:b] in seen
            seen.add(raw[a:b])
            if late and spans and spans[-1][1] == a:
                spans[-1][1] = b
            elif late:
                spans.append([a, b])
        spans = [s for s in spans if s[1] - s[0] >= 32]
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        want.append((i, len(raw), len(cut), sum(b - a for a, b in spans), tuple(a for a, _ in spans), (kept + raw[at:]).decode()))
    got = [(r.doc_id, r.n_bytes, r.n_chunks, r.n_removed, tuple(r.starts), r.kept) for r in chunks.deduplicate(docs).collect()]
    assert Counter(got) == Counter(want)
    assert any(w[3] > 300 for w in want)


def test_an_insertion_moves_no_later_boundary():
    import numpy as np
    raw = ("some words that go on and on without any repetition " + " ".join(str(i * i) for i in range(400))).encode()
    cut = [b for _, b in plain_chunks(raw)]
    more = b"inserted " + raw
    doc, start, end = chunks.boundaries(np.frombuffer(more, np.uint8), np.array([0, len(more)]))
    assert {b + 9 for b in cut if b > 300} <= set(end.tolist())


def plain_runs(text, k):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_decontamination_finds_exactly_the_contained_items(spark, docs, rows):
    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(1, " ".join(texts[0].split()[5:40])), (2, " ".join(texts[1].upper().split()[3:30]).replace(".", " !")), (3, None), (4, ""), (5, "one two three"), (6, "never seen in any of the texts at all"),
             (7, " ".join(texts[2].split()[:30]) + " and then some other words"), (8, " ".join(texts[2].split()[:12]) + " half of it is quite another text with its own words now"), (None, texts[3]), (1, " ".join(texts[0].split()[38:50]))]
    item_sets, doc_sets = defaultdict(set), defaultdict(set)
    for i, t in items:
        if i is not None:
            item_sets[i] |= plain_runs(t, 5)
    for i, t in rows:
        doc_sets[i] |= plain_runs(t, 5)
    want = {(d, i, len(s), len(s & ds)) for i, s in item_sets.items() if s for d, ds in doc_sets.items() if 100 * len(s & ds) >= 80 * len(s)}
    found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in found.collect()} == want
    assert {i for _, i, *_ in want} >= {1, 2, 5, 7} and not {i for _, i, *_ in want} & {6, 8}


def plain_components(sets, linked):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(sets)):
        for y in range(x):
            if sets[x] and sets[y] and linked(sets[x], sets[y]):
                root[find(x)] = find(y)
    return [find(x) for x in range(len(sets))]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_all_pairs(docs, rows, k):
    sets = []
    for _, t in rows:
        w = BLANK.findall(lowered(t))
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = plain_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    least = defaultdict(list)
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r].append(i)
    want = Counter()
    for (i, t), s, r in zip(rows, sets, root):
        c = min(least[r], default=None) if s else i
        want[i, len(s), c, i == c, zlib.crc32((t or "").encode())] += 1
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, k).collect()) == want
    assert max(Counter(root).values()) >= 4


def test_a_chain_of_near_duplicates_is_one_component(spark):
    """Neighbours in the chain are linked, its ends share little: the bands' smallest members do not see all links."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for step in range(14):
        w = base[:]
        for j in range(step):
            w[j * 8:j * 8 + 3] = [f"n{j}a", f"n{j}b", f"n{j}c"]
        rows.append((500 - step, " ".join(w)))
    got = minhash.near_duplicates(frame(spark, rows), 4).collect()
    assert {r.component_id for r in got} == {487} and sum(r.kept for r in got) == 1


def test_lines_equal_all_pairs(docs, rows):
    sets = defaultdict(list)
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            w = frozenset(BLANK.findall(lowered(line)))
            if w:
                sets[w].append((key(i), p))
    head = {w: min(at) for w, at in sets.items()}
    similar = {w for w in head for v in head if head[v] < head[w] and 100 * len(w & v) >= 80 * len(w | v)}
    want = Counter()
    repeated = Counter(i for i, _ in rows)
    for i, t in rows:
        if repeated[i] > 1:
            continue  # which of the rows with one id comes first is not fixed
        kept = []
        for p, line in enumerate((t or "").split("\n")):
            w = frozenset(BLANK.findall(lowered(line)))
            if not w or (head[w] == (key(i), p) and w not in similar):
                kept.append(line)
        want[i, "\n".join(kept), len((t or "").split("\n"))] += 1
    got = lines.deduplicate(docs, carried=["lang", "batch", "part", "words", "id"])
    assert got.columns == ["doc_id", "text", "lang", "batch", "part", "words", "id", "n_lines", "n_removed", "lines_removed"]
    found = got.collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.text or "", r.n_lines) for r in found if repeated[r.doc_id] == 1) == want
    assert similar and all(r.n_removed == len(r.lines_removed) for r in found)


def test_lines_of_a_large_group_equal_all_pairs(spark):
    """Hundreds of lines around one base: some are similar to it, and many pairs of them are not similar to each other."""
    import random
    rng = random.Random(6)
    base = [f"base{i}" for i in range(24)]
    rows = []
    for i in range(260):
        w = base[:]
        for j in range(rng.randint(1, 5)):
            w[rng.randrange(24)] = f"own{i}x{j}"
        rows.append((1000 - i if i % 2 else i, " ".join(w)))
    sets = {i: set(t.split()) for i, t in rows}
    gone = {i for i in sets if any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
    got = {r.doc_id: r.n_removed for r in lines.deduplicate(frame(spark, rows)).collect()}
    assert {i for i, n in got.items() if n} == gone and 0 < len(gone) < 260


def test_substrings_equal_all_windows(docs, rows):
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p:p + 50]
            least[w] = min(least.get(w, float("inf")), key(i))
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p:p + 50]] < key(i):
                gone[p:p + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = regex.findall(rb"\x01+", bytes(gone))
        want[i, len(raw), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()] += 1
    got = substrings.deduplicate(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == want
    assert sum(1 for w in want if w[2]) > 10


def test_suffix_arrays_are_sorted():
    import numpy as np
    from tidemark.llm import suffixes
    rng, before = np.random.default_rng(3), (suffixes.BYTES, suffixes.TOGETHER)
    try:
        for trial in range(150):
            t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 120))
            t = np.append(np.tile(t[:5], 25) if trial % 4 == 0 else t, 0)
            suffixes.BYTES, suffixes.TOGETHER = (2, 258)[trial % 2], (1, 4, 24, 1000)[trial % 4 if trial % 5 else 0]
            raw = bytes(t.tolist())
            assert suffixes.suffix_array(t).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    finally:
        suffixes.BYTES, suffixes.TOGETHER = before


def test_packing_places_every_piece_once(docs, rows):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start:start + 256]
            want[i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    got = packing.pack(packing.pieces(docs, capacity=256), 256).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(w[3] * n for w, n in want.items()) // 256) + 1


def test_packing_of_texts_that_name_special_tokens(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = [(i, t) for i, t in enumerate(["end <|endoftext|> next", "a<|endoftext|>b", "<|startoftext|>\none\t<|endoftext|><|endoftext|>  two", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >"])]
    want = {(i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) for i, t in rows for ids in [[*tokenizer.encode(t, add_special_tokens=False).ids, 0]]}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in packing.pieces(frame(spark, rows)).collect()} == want


def test_the_fullest_combination_is_found():
    import itertools
    import random
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(1, 60)
        used = packing.fullest(counts, room)
        best = max(s for n in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(a * b for a, b in zip(n, counts))) <= room)
        assert sum(a * b for a, b in used.items()) == best and all(used[k] <= counts[k] for k in used)


def test_shards_are_near_equal_and_gapless(docs, rows):
    got = slots.shard(docs, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    places, load = defaultdict(list), Counter()
    for r in got:
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    longest = max(len((t or "").encode()) for _, t in rows)
    assert max(load.values()) - min(load.values()) <= max(200, 2 * longest - sum(load.values()) // 4)


def test_growing_moves_slots_to_the_new_shard_only(spark, tmp_path):
    import numpy as np
    load = np.random.default_rng(2).integers(0, 5000, slots.SLOTS)
    first = slots.first_map(8)
    even = slots.rebalance(first, load, 8)
    total = np.bincount(even, weights=load, minlength=8)
    assert total.max() - total.min() <= 2
    grown = slots.grow(even, load, 8)
    moved = np.flatnonzero(grown != even)
    assert len(moved) and (grown[moved] == 8).all()
    total = np.bincount(grown, weights=load, minlength=9)
    assert total.max() < 1.02 * total.mean()
    folder = str(tmp_path / "map")
    for version, (now, before) in enumerate([(first, None), (even, first), (grown, even)]):
        slots.store_map(spark, folder, version, now, before)
    for version, now in enumerate([first, even, grown]):
        stored = {r.virtual_slot: r.shard for r in slots.load_map(spark, folder, version).collect()}
        assert [stored[s] for s in range(slots.SLOTS)] == now.tolist()


def test_empty_tables(spark, empty, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    for made in (chunks.deduplicate(empty), decontaminate.leaks(empty, items), decontaminate.leaks(docs, items), minhash.near_duplicates(empty), lines.deduplicate(empty),
                 substrings.deduplicate(empty), packing.pack(packing.pieces(empty)), slots.shard(empty)):
        assert made.count() == 0


def test_near_copies_with_null_and_repeated_ids(spark):
    """A text without an id links others as any text does, and the pipeline leaves one row of every component."""
    import corpus_pipeline

    def text(name, *changed):
        return " ".join(f"{name}{i}" if i not in changed else f"other{name}{i}" for i in range(120))
    rows = [(None, text("a")), (7, text("a", 20)),
            (5, text("b", 10, 30)), (None, text("b")), (9, text("b", 60, 90)),
            (None, text("c")), (None, text("c")), (None, text("c", 50)),
            (3, text("d")), (3, text("d", 50)), (3, text("d")), (3, text("e")), (4, "")]
    component = {"a": 7, "b": 5, "c": None, "d": 3, "e": 3}
    docs = frame(spark, rows).repartition(3)
    got = {(r.doc_id, r.text_crc32): r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {(i, zlib.crc32(t.encode())): component[t.removeprefix("other")[0]] if t else i for i, t in rows}
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert set(left) <= set(rows)
    assert Counter(t.removeprefix("other")[:1] for _, t in left) == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "": 1}
    assert {i for i, t in left if t[:1] in ("a", "b")} == {7, 5}
