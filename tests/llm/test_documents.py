"""Operators on documents: edge cases with defined results, and brute force on a small table."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, fingerprint, packing, pieces, queries, simhash, substring, toxicity
from tidewell.llm.bpe import encoder, load_ids

SCHEMA = "doc_id long, text string, id string, at int, line string"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i} goes" for i in range(9000)) + ". End of it. Really the end of it all."
PASSAGE = "The first part stands here. Another part follows with several words. A third one closes the whole passage now. And more."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "l") for i, t in rows], SCHEMA)


EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "null id text"), (5, LONG), (6, "\n\n \n"), (7, "é" * 50)]


# --- substring dedup -------------------------------------------------------------------------


def test_substring_rows_of_one_id_or_of_none_are_told_apart(spark):
    own = "Nothing of this text stands anywhere else. Not its second sentence with these words either. Nor is the third one found elsewhere. And so on."
    got = substring.remove_repeats(frame(spark, [(1, PASSAGE), (7, PASSAGE), (7, own), (None, own + " Later.")])).collect()
    assert {(r.doc_id, r.text, r.removed_sentences > 0) for r in got if r.doc_id} == {(1, PASSAGE, False), (7, "", True), (7, "", True)} or {
        (r.doc_id, r.text) for r in got
    } >= {(1, PASSAGE), (None, own + " Later.")}
    alone = substring.remove_repeats(frame(spark, [(1, PASSAGE), (7, PASSAGE), (7, own)])).collect()
    assert sorted((r.doc_id, r.removed_sentences > 0) for r in alone) == [(1, False), (7, False), (7, True)]
    assert own in {r.text for r in alone}


def test_substring_keeps_clashing_columns(spark):
    docs = frame(spark, [(1, PASSAGE), (2, PASSAGE)]).withColumns({"own id": F.lit("keep"), "row": F.lit(5), "Removed_Chars": F.lit("old")})
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert (got[1]["own id"], got[2]["row"], got[1]["removed_chars"]) == ("keep", 5, 0) and got[2]["removed_chars"] == len(PASSAGE)


def test_substring_cuts_all_but_the_first(spark):
    rows = [(9, f"Some words before it {PASSAGE} and after."), (4, f"Other start. {PASSAGE} Other end."), (7, "Nothing shared here at all.")]
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got[4].text == rows[1][1] and got[4].removed_chars == 0
    assert PASSAGE not in got[9].text and got[9].text.startswith("Some words before it ") and got[9].removed_sentences >= 4
    assert got[7].text == rows[2][1]
    assert got[4].id == "x" and got[4].at == 7


def test_substring_edges(spark):
    got = substring.remove_repeats(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and {(r.doc_id, r.text) for r in got} == set(EDGE)
    assert substring.remove_repeats(frame(spark, EDGE).limit(0)).count() == 0


def test_substring_within_one_document(spark):
    text = f"{PASSAGE} Between them stands this. {PASSAGE}"
    (got,) = substring.remove_repeats(frame(spark, [(1, text)])).collect()
    assert got.text.count("A third one closes") == 1


def test_substring_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    seen, gone = {}, defaultdict(set)
    for i, text in texts:
        starts, hashes, words = substring.sentences(text)
        assert starts[0] == 0 and len(starts) == len(hashes) == len(words)
        for h, place in zip(*substring.span_hashes(hashes, words, 3, 8), strict=True):
            if int(h) in seen:
                gone[i].update(range(place // substring.CODE, place // substring.CODE + place % substring.CODE))
            seen[int(h)] = i
    got = {r.doc_id: r.removed_sentences for r in substring.remove_repeats(docs).collect()}
    assert got == {i: len(gone[i]) for i, _ in texts}


# --- fingerprints ----------------------------------------------------------------------------


def test_prefix_hash_answers_spans():
    a, b = fingerprint.PrefixHash("abracadabra"), fingerprint.PrefixHash("xxabracadxbra")
    assert fingerprint.spans_equal(a, 0, a, 7, 4) and not fingerprint.spans_equal(a, 0, a, 1, 4)
    assert fingerprint.common_extension(a, 0, b, 2) == 7
    assert fingerprint.fingerprint(fingerprint.PrefixHash("")) == fingerprint.fingerprint(fingerprint.PrefixHash(""))


def test_fingerprints_match_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, small).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == fingerprint.fingerprint(fingerprint.PrefixHash(text))
        assert 0 <= got[i].near_next <= 1 and got[i].common_edited >= len(text) - cut
    near = np.mean([r.near_edited for r in got.values()])
    assert 0.4 < near < 0.65 and np.mean([r.near_next for r in got.values()]) < 0.1


def test_fingerprint_edges(spark):
    got = fingerprint.fingerprint_documents(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert None in by
    (alone,) = fingerprint.fingerprint_documents(frame(spark, [(1, "abcd")])).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0
    assert fingerprint.fingerprint_documents(frame(spark, EDGE).limit(0)).count() == 0


# --- pieces ----------------------------------------------------------------------------------


def test_samples_are_distinct_ranked_and_round_trip(spark):
    got = pieces.sample_segmentations(frame(spark, [*EDGE, (8, "A  b\tc\n")]), PIECES, k=3, alpha=0.0005).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        if r.ids:
            assert r.decoded == dict(EDGE + [(8, "A  b\tc\n")])[r.doc_id]
    assert [len(r.ids) for r in by[1]] == [0] and [len(r.ids) for r in by[2]] == [0]
    assert len({tuple(r.ids) for r in by[5]}) == 3
    values = [r.perturbed for r in sorted(by[5], key=lambda r: r.sample)]
    assert values == sorted(values, reverse=True)
    assert {tuple(r.ids) for r in by[3]} and all(r.log_prob <= 0 for r in got)
    assert pieces.sample_segmentations(frame(spark, EDGE).limit(0), PIECES).count() == 0


def test_samples_follow_the_lattice():
    m = pieces.model(PIECES)
    text, alpha, n = "abcd the", 0.00003, 3000
    ids = {m.processor.id_to_piece(i): i for i in range(m.size) if not m.processor.is_byte(i)}

    def ways(word):
        if not word:
            yield ()
        for k in range(1, len(word) + 1):
            if word[:k] in ids:
                for rest in ways(word[k:]):
                    yield (ids[word[:k]], *rest)

    a, b = (list(ways(u)) for u in pieces.units(text))
    weight = {x + y: np.exp(alpha * sum(m.scores[list(x + y)])) for x in a for y in b}
    p = {k: v / sum(weight.values()) for k, v in weight.items()}
    found = pieces.sample_texts(m, [text] * n, list(range(1, n + 1)), 3, alpha)
    first, estimate = defaultdict(float), defaultdict(float)
    for rows in found:
        keys = [tuple(r[0].tolist()) for r in rows]
        assert len(set(keys)) == 3
        first[keys[0]] += 1 / n
        for key, (_, log, _, included) in zip(keys, rows, strict=True):
            assert log == pytest.approx(np.log(p[key]), abs=1e-6)
            estimate[key] += p[key] / np.exp(included) / n  # Horvitz-Thompson
    for key in sorted(p, key=p.get, reverse=True)[:5]:
        assert first[key] == pytest.approx(p[key], abs=0.025)
        assert estimate[key] == pytest.approx(p[key], abs=0.025)


def test_all_segmentations_when_there_are_few():
    m = pieces.model(PIECES)
    (rows,) = pieces.sample_texts(m, ["日"], [1], 5, 0.001)
    assert 1 <= len(rows) <= 5 and rows[-1][3] == 0.0 and all(m.decode(r[0]) == "日" for r in rows)


def test_pieces_of_short_texts_are_as_many_as_there_are():
    """Unlikely ones too: every segmentation of a short text can be sampled, and none twice."""
    m = pieces.model(PIECES)
    for text in ("a", "I", "ab", "Von.", "Osrañ.", "Pachque çaneux et.", "the end"):
        lattices = pieces.Lattices(m, list(set(pieces.units(text))), pieces.ALPHA)
        paths = 1
        for unit in pieces.units(text):
            word = lattices.place[unit]
            taken, n = [], 0
            while n < 6:
                path, log = lattices.draw_other(word, taken, random.Random(n))
                if not path:
                    break
                # what is left is what all weigh without the taken ones
                assert log <= lattices.log_rest(word, taken) + 1e-9
                taken.append(path)
                n += 1
            assert len(set(taken)) == n
            paths *= n
        for seed in range(40):
            (rows,) = pieces.sample_texts(m, [text], [seed], 3)
            assert len(rows) == min(3, paths), (text, seed)
            assert len({r[0].tobytes() for r in rows}) == len(rows)
            assert all(m.decode(r[0]) == text for r in rows)


def test_pieces_write_blanks_as_their_mark():
    m = pieces.model(PIECES)
    (rows,) = pieces.sample_texts(m, ["a▁b"], [1], 2)
    assert {m.decode(r[0]) for r in rows} == {"a b"}



def test_encode_is_the_models_own(spark):
    got = {r.doc_id: r.ids for r in pieces.encode(frame(spark, [(1, "the end"), (2, None)]), PIECES).collect()}
    assert got[1] == pieces.model(PIECES).processor.encode("the end") and got[2] == []


# --- packing ---------------------------------------------------------------------------------


def test_first_fit_decreasing_is_first_fit():
    random = np.random.default_rng(1)
    for _ in range(30):
        sizes = random.integers(1, 101, random.integers(1, 80)).tolist()
        room, expected = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if at is None:
                at = len(room)
                room.append(100)
            expected[i] = (at, 100 - room[at])
            room[at] -= sizes[i]
        assert dict(enumerate(packing.first_fit_decreasing(sizes, 100))) == expected


def _check_packed(pieces_, texts, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    parts, room = defaultdict(list), defaultdict(list)
    for r in pieces_:
        parts[r.doc_id].append((r.start, bytes(r.ids)))
        room[r.sequence_id].append((r.offset, r.length))
        assert r.length * 4 == len(r.ids)
    for i, text in texts.items():
        ids = [x for _, part in sorted(parts[i]) for x in load_ids(part).tolist()]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 1]
    for own in room.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length


def test_packing_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = packing.pack(docs, BPE, 256).collect()
    _check_packed(got, {r.doc_id: r.text for r in docs.collect()}, 256)
    used = sum(r.length for r in got)
    assert used / (256 * len({r.sequence_id for r in got})) > 0.97


def test_packing_edges(spark):
    rows = [(i, t) for i, t in EDGE if i != 3]
    got = packing.pack(frame(spark, rows), BPE, 512).collect()
    _check_packed(got, dict(rows), 512)
    assert packing.pack(frame(spark, [(1, "same")] * 40), BPE, 16, group_docs=4).count() == 40
    assert packing.pack(frame(spark, rows).limit(0), BPE).count() == 0
    row = packing.with_checksums(packing.pack(frame(spark, [(1, "a")]), BPE)).first()
    assert row.ids_crc32 == zlib.crc32(encoder(BPE)("a") + np.array([1], "<u4").tobytes())


# --- simhash ---------------------------------------------------------------------------------


def _components(fps, radius):
    n = len(fps)
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(close[i]):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_matches_brute_force(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    fps = np.array([simhash.simhash(t) for _, t in rows], dtype=np.uint64)
    label = _components(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, small).collect()}
    assert got == {i: (f"{int(f):016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, label, strict=True)}


def test_simhash_bits():
    import xxhash

    text = "The quick  brown\tfox jumps"
    grams = ["the quick brown fox", "quick brown fox jumps"]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    assert simhash.simhash(text) == h[0] & h[1]
    assert simhash.simhash("Ab C") == xxhash.xxh64_intdigest("ab c", 42) and simhash.simhash(" \n") == 0


def test_bk_tree_shard_links():
    random = np.random.default_rng(3)
    base = random.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << random.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]]))
    label = list(range(len(points)))
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    links = simhash.shard_links(points, 4)
    assert len(links) < len(points)
    for a, b in links:
        x, y = label[place[a]], label[place[b]]
        label = [min(x, y) if v in (x, y) else v for v in label]
    assert label == _components(points, 4)


def test_simhash_edges(spark):
    got = simhash.near_duplicates(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 6)} == {1}
    assert [r.component_id for r in got if r.doc_id == 3] == [3, 3]
    assert simhash.near_duplicates(frame(spark, EDGE).limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    chain = toxicity.train(docs, labels.where(~held), ["low_quality", "toxic"])
    got = toxicity.score(docs, chain).join(labels.where(held), "doc_id").select("p_toxic", "toxic").collect()
    right = np.mean([(r.p_toxic >= 0.5) == (r.toxic == 1) for r in got])
    assert right > 0.93 and len(chain.links[1]) == 1


def test_chain_uses_out_of_fold_predictions():
    random = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        a = int(random.random() < 0.5)
        rows.append(({"bad": 1} if a else {"fine": 1}, (a, a)))
    chain = toxicity.fit_chain(rows, ["x", "y"], [["bad", "fine"], []])
    assert chain.predict("bad")[1] > 0.8 and chain.predict("fine")[1] < 0.2 and chain.links[1][0] > 0
    again = toxicity.Chain.from_json(chain.to_json())
    assert again.predict("bad") == chain.predict("bad")


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    docs = frame(spark, EDGE).withColumn("p_toxic", F.lit("old"))
    chain = toxicity.train(docs, labels, ["toxic"])
    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(EDGE) and all(0 <= r.p_toxic <= 1 for r in got)
    empty = toxicity.train(docs, labels.limit(0), ["toxic"])
    assert all(r.p_toxic < 0.01 for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0


# --- chat ------------------------------------------------------------------------------------


def test_escape_is_reversible():
    for text in [*chat.CONTROL, "".join(chat.CONTROL), r"a\b\\:c", r"<\:/s>", "</</s>s>", "plain", ""]:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat_reads_back(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "[INST] hi"), (1, None, None, None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", LONG)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, input_ids string")
    turns = chat.format_turns(df, BPE)
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(turns), BPE).collect()}
    said = [("", ""), ("user", "[INST] hi"), ("assistant", "yes </s>")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 8, hashlib.sha256(b"yes </s>").hexdigest())
    assert got[2].n_turns == 2 and got[2].loss_chars == 2
    assert got[None].loss_chars == 0 and got[None].formatted_chars > len(LONG)
    assert chat.read_back(chat.assemble(chat.format_turns(df.limit(0), BPE)), BPE).count() == 0


def test_chat_whole_table(spark, small):
    got = {r.conv_id: r for r in queries.op7_chat(spark, small).collect()}
    own = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own[r.conv_id].append((r.role or "", r.text or ""))
    own[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == own.keys()
    for i, said in own.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[i].n_turns == len(said) and got[i].loss_chars == len(loss)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
