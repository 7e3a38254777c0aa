"""Every operator against a brute-force version on small tables that hold the odd cases."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegate.llm import bpe, caps, jaccard, language, packing, preference, substring, topk, toxicity, warc
from tidegate.llm.catalog import VOCABULARY
from tidegate.llm.tokens import Encoder, Vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(pool, size=n)) for n in (80, 120, 200, 300)]
    passage = " ".join(rng.choice(pool, size=70))
    near = base[2].split()
    near[100] = "changed"
    far = base[2].split()
    far[::4] = ["other"] * len(far[::4])
    return [
        base[0], base[1], base[2], base[2], " ".join(near), " ".join(far), base[3] + " " + passage,
        passage + " " + base[0][:100], "", None, " \t\n", "one two", "one two", "ONE Two", "naïve café \U0001f600 " * 9,
        " ".join(rng.choice(pool, size=20_000)), "a " * 300,
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def roots(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_packing_places_every_token_once(docs, none, texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = packing.packed_digests(docs, VOCABULARY).collect()
    held = {}
    for row in rows:
        held.setdefault(row.doc_id, []).append(row)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(held[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert len(mine) == -(-len(ids) // 1024)
        at = 0
        for row in mine:
            part = np.array(ids[at : at + row.length], dtype="<u4").tobytes()
            assert (row.start, row.ids_crc32) == (at, zlib.crc32(part))
            at += row.length
        assert at == len(ids) and all(r.length == 1024 for r in mine[1:])
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 1024) + 1
    assert packing.packed_digests(none, VOCABULARY).count() == 0


def test_plain_texts_are_merged_whole_and_all_texts_as_the_library_does():
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), Encoder(Vocabulary.load(VOCABULARY))
    plain = ["", "It's a text, isn't it?\nI'll say 12 'twas", "é" * 3000, "n" * 3000, "\nx", "½ª²× ¡ß\u00ad1.a"]
    odd = ["two  blanks", " \n", "a\tb", "a\u00a0b", "a\x00 b", "an <|endoftext|> here", "жук’s 漢字 and\nmore", "x\x85y"]
    ids = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in plain + odd]
    assert encoder.encode(plain) == ids[: len(plain)] and encoder.known == {"": b""}
    assert encoder.encode(odd + plain) == ids[len(plain) :] + ids[: len(plain)]


def test_toxicity_bounds_and_held_out(spark, none):
    rows = [(i, ("you are a vile zorgblat " if i % 2 else "a calm walk by the lake ") + f"x{i}", "en", "s", 1) for i in range(300)]
    rows += [(1000, "", None, None, 0), (1001, None, None, None, None), (1002, "zorgblatt vile", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    assert set(found) == {r[0] for r in rows}
    for row in found.values():
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.7)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
    unseen = [found[i] for i in range(300) if found[i].held_out]
    assert unseen and all((r.score > 0.5) == bool(r.doc_id % 2) for r in unseen)
    assert found[1002].score > 0.5
    assert toxicity.score(none, toxicity.train(none, labels.where("false"))).count() == 0


def test_preference_pairs(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (1, 0, "user", "hi"), (1, 1, "assistant", "go away"),
        (2, 0, "user", "alone"), (4, 0, None, None), (5, 0, None, None), (None, 0, "user", "lost"), (6, None, "user", "lost"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {r.pair_id: r for r in preference.neighbours(frame).collect()}
    assert set(found) == {0, 2, 4}
    one = found[0]
    assert one.n_common == 1 and "hi" in one.prompt and one.prompt.count("hi") == 1
    for side, spans, answer in ((one.chosen, one.chosen_spans, "hello"), (one.rejected, one.rejected_spans, "go away")):
        assert [side[s["start"] : s["end"]].startswith(answer) for s in spans] == [True]
    assert found[4].n_common == 1 and found[4].chosen == found[4].rejected == ""


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16)).astype("float32")
    base[60:100] = base[:40] + rng.normal(scale=0.03, size=(40, 16)).astype("float32")
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    rows += [(i, rows[7][1], 1) for i in range(120, 150)]  # copies
    rows += [(150, None, 1), (151, [0.0] * 16, 1), (152, [float("nan")] + [1.0] * 15, 1), (153, [None] + [1.0] * 15, 1)]
    return rows + [(154, rows[7][1], None)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_topk_is_exact(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, VECTORS)
    good = {i: v for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    whole = {i: np.floor(256 * np.array(v, dtype="float32").astype(float)).astype(int) for i, v in good.items()}
    expected = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    found = topk.search(frame, frame.vec_id % 50 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected
    assert topk.search(frame.where("false"), frame.vec_id % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1e3, 1e6, 1e9, 1e18, 1e37])
def test_topk_is_exact_for_any_size(spark, size):
    """Sums past 2^53 and past a long, best scores below zero, and a query id that fills the top itself."""
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.uniform(-size, size, (60, 24)), -rng.uniform(size / 2, size, (20, 24))])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(values)] + [(50, [float(size)] * 24, 0)] * 8
    rows += [(200, [abs(float(x)) for x in values[3]], 0), (201, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows]
    expected = set()
    for q, v in {(i, tuple(v)) for i, v in whole if i % 50 == 0 and i != 50}:
        sums = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:5]
        expected |= {(q, n + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(sums)}
    found = topk.search(frame, (frame.vec_id % 50 == 0) & (frame.vec_id != 50)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected and len(found) == 10


def test_topk_own_id_does_not_lift_the_bar():
    ids = np.array([7] * 9 + [1, 2, 3])
    vectors = np.concatenate([np.full((9, 4), 50.0), np.arange(12.0).reshape(3, 4)])
    found = topk.Shard(ids, vectors).search(np.full(4, 50.0), 7, 2, None)
    assert found == [(-50 * 38, 3), (-50 * 22, 2)]


def test_caps_link_what_brute_force_links(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, VECTORS)
    good = {i: (np.array(v), label) for i, v, label in rows
            if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: (v / np.linalg.norm(v), label) for i, (v, label) in good.items()}
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.98]
    root = roots([r[0] for r in rows], links)
    found = {r.vec_id: r for r in caps.near(frame).collect()}
    assert set(found) == set(root)
    true = sum(2 for _ in links)
    assert 0.9 * true <= sum(r.n_links for r in found.values()) <= true
    assert all(r.kept == (r.component_id == r.vec_id) for r in found.values())
    assert np.mean([found[i].component_id == root[i] for i in root]) >= 0.9


def removed(texts, width=50):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_substring_removes_what_brute_force_removes(docs, none, texts):
    expected = removed(texts)
    for frame in (substring.digests(docs),):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}
        assert found == dict(enumerate(expected))
    assert substring.digests(none).count() == 0


def test_substring_over_many_blocks(docs, texts):
    """Blocks of a few texts: passages are found across them."""
    spans = {r.doc_id: r.spans for r in substring.spans(docs, block_bytes=2_000).collect()}
    for i, (n, gone, _) in enumerate(removed(texts)):
        words = list(range(n))
        assert n - len(substring.keep(words, spans[i])) == gone


def test_bpe_equals_the_library(docs, none, texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    lexicon = bpe.build_lexicon(docs, VOCABULARY)
    found = {r.doc_id: r for r in bpe.digests(docs, VOCABULARY, lexicon).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.digests(none, VOCABULARY, lexicon).count() == 0


def test_jaccard_links_what_brute_force_links(docs, none, texts):
    sets = []
    for text in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    links = [(a, b) for a, b in combinations(range(len(sets)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(range(len(sets)), links)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert found == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard.join(none).count() == 0


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 80
    rows = [(4, "http://a", long), (2, "http://b", long), (9, None, long), (1, "http://c", "tiny"), (3, "http://d", "tiny"),
            (5, "http://e", None), (6, "http://f", ""), (7, "http://g", "y" * 100), (8, "http://h", "y" * 99)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.round_trip(frame).collect()}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = html == long and i != 2
        assert (found[i].record_type, found[i].refers_to) == (("revisit", 2) if revisit else ("response", None))
    assert warc.round_trip(frame.where("false")).count() == 0


def test_warc_repeated_ids_and_damage(spark, tmp_path):
    body, other = "x" * 150, "y" * 150
    rows = [(2, "u", body), (2, "u", body), (4, None, body), (4, "u", other), (7, "u", other), (None, "u", body)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id, r.payload_digest[:4], r.record_type, r.refers_to) for r in warc.round_trip(frame).collect())
    x, y = (hashlib.sha256(b.encode()).hexdigest()[:4] for b in (body, other))
    assert found == sorted([(2, x, "response", None)] * 2 + [(4, x, "revisit", 2), (4, y, "response", None), (7, y, "revisit", 4)])

    warc.write(warc.headers(frame), str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    for n, file in enumerate((tmp_path / "good").glob("*.txt.gz")):
        data = warc.gzip.decompress(file.read_bytes()).replace(b"yyyy", b"yyzy", 1)
        assert b"Content-Type: text/html" in data
        (tmp_path / "bad" / f"{n}.txt.gz").write_bytes(warc.gzip.compress(data))
    read = warc.resolved(warc.read(spark, str(tmp_path / "bad"))).collect()
    assert sorted((r.page_id, r.record_type, r.intact, r.length) for r in read) == sorted(
        [(2, "response", True, 150)] * 2 + [(4, "revisit", True, 150), (4, "response", False, 150), (7, "revisit", False, None)],
        key=lambda r: (r[0], r[1], r[2]),
    )


def test_language_of_held_out_texts(spark, none):
    said = {"en": "the quick brown fox jumps over the lazy dog and runs", "de": "der schnelle braune fuchs springt und läuft davon",
            "ru": "быстрая лиса прыгает"}
    rows = [(i, said[lang] + f" {i}", lang, "s", 1) for i, lang in enumerate(list(said) * 40)]
    rows += [(500, None, "en", None, None), (501, "", "en", "s", 0), (502, "123 456", "en", "s", 7), (503, said["de"], None, "s", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in language.identify(frame, language.train(frame)).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == "und" for i in (500, 501, 502)) and found[503].lang_pred == "de"
    assert all(found[i].lang_pred == lang for i, _, lang, _, _ in rows[:120] if found[i].held_out)
    assert language.identify(none, language.train(none)).count() == 0


def test_workers_get_batches_of_bounded_bytes(spark):
    from tidegate.llm.common import BATCH_BYTES, start

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.nbytes]})

    rows = start(spark).range(0, 2000, 1, 1).selectExpr("repeat('x', 20000) AS text")
    found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 40_000_000 and max(found) < 2 * BATCH_BYTES
