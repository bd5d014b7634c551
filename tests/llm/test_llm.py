import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bcr, bpe, chat, decontaminate, licenses, ngram_join, quality, sharding, substring, suffix_dedup, token_files
from tablewright.llm._arrow import SLICE_BYTES
from tablewright.llm._shared import shared_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil jars of liquid amber near a frozen lake at dawn today"
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))  # polynomial hashes modulo powers of two take it for MORSE
TEXTS = [None, "", "  \n\t ", "short", BASE, BASE, BASE.replace("seven", "eight"), f"{BASE} {BASE}", "| " * 300, "ab" * 400, LONG, f"Zürich {LONG[:900]} ñandú", "x\n\n" + BASE + "\nsame line here\nsame line here\n", "Don't 'RE we'll <|endoftext|> ok　中文   1²½", "Released under\nthe MIT  License. " + BASE,
         f"{MORSE} {OTHER}", f"{MORSE}\n{OTHER}\n", " ".join([MORSE, *LONG.split()[:20]]), " ".join([OTHER, *LONG.split()[:20]])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(TEXTS)] + [(4, BASE, "en", "s", 4), (None, BASE, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words long")


def ids(frame):
    return {r.doc_id: r for r in frame.where("doc_id IS NOT NULL").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality(docs):
    out = ids(quality.quality_rules(docs))
    for i, t in enumerate(TEXTS):
        w, seen, covered = words(t), defaultdict(int), set()
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])] += 1
        for k in range(len(w) - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                covered.update(range(k, k + 8))
        assert (out[i].n_words, out[i].n_repeat_words) == (len(w), len(covered))
        assert out[i].base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert out[10].kept and not out[8].kept and out[12].n_dup_lines == 1 and out[16].n_dup_lines == 0
    assert quality.quality_filter(docs).columns == docs.columns


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(2)
    for _ in range(50):
        w = rng.integers(0, 3, rng.integers(1, 30))
        end = np.full(len(w), len(w))
        levels = quality.suffix_ranks(w.astype(np.int64), end)
        order = sorted(range(len(w)), key=lambda i: w[i:].tolist())
        assert [order.index(i) for i in range(len(w))] == levels[-1].tolist()


def test_ngram_join(docs):
    out = ids(ngram_join.jaccard_components(docs))
    sets = {i: {tuple(x) for x in zip(*[words((t or "").lower())[k:] for k in range(5)], strict=False)} or ({tuple(words(t.lower()))} if words(t) else set()) for i, t in enumerate(TEXTS)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert {i: r.component_id for i, r in out.items()} == label
    assert {i: r.n_shingles for i, r in out.items()} == {i: len(s) for i, s in sets.items()}
    clash = docs.withColumns({c: F.lit("x") for c in ("gone_id", "n", "d1", "text_hash", "stays", "row")}).unionByName(docs.where("doc_id = 11").withColumn("text", F.lit("another text of its own")), allowMissingColumns=True)
    kept = ngram_join.one_of_each_group(clash)
    assert kept.columns == clash.columns and kept.where("doc_id = 5").count() == 0
    assert kept.where("doc_id = 4").count() == 1 and kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id = 11").count() == 2
    assert kept.count() == 2 + len(set(label.values()))


def test_ngram_links(spark):
    rng = np.random.default_rng(5)
    base = [f"a{k}" for k in range(60)]
    rows = []
    for i in range(60):  # near copies of each other, with every count of links, and some equal ones
        w = list(base) if i < 40 else [f"b{k}" for k in range(40)]
        for k in rng.integers(len(w) - 6, len(w), i % 4):
            w[k] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    for tile in (ngram_join.TILE_SHINGLES, 300):
        sets = {i: {tuple(x) for x in zip(*[t.split()[k:] for k in range(5)], strict=False)} for i, t in rows}
        head = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
        linked = {i: sum(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in set(head.values()) - {i}) for i in set(head.values())}
        old, ngram_join.TILE_SHINGLES = ngram_join.TILE_SHINGLES, tile
        try:
            out = ngram_join.jaccard_join(spark.createDataFrame([*rows, rows[0], rows[7], (None, rows[0][1]), (99, None)], "doc_id long, text string")).collect()
        finally:
            ngram_join.TILE_SHINGLES = old
        assert len(out) == 64 and sum(linked.values()) > 2 * len(linked)
        assert {(r.doc_id, r.class_id, r.n_links) for r in out} == {(i, head[i], linked[head[i]]) for i in sets} | {(None, None, None), (99, 99, 0)}


def test_token_files(spark, docs):
    path, t = shared_path(spark, "t"), Tokenizer.from_file(PATH)
    token_files.write_tokens(docs.where("doc_id IS NOT NULL"), path, PATH, 2, dictionary_bytes=1024)
    got = sorted(map(tuple, token_files.token_digests(token_files.read_tokens(spark, path)).collect()))
    at, expected = 0, []
    for i, text in sorted([*enumerate(TEXTS), (4, BASE)], key=lambda x: x[0]):
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
        expected.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == expected
    assert token_files.read_tokens(spark, path, 10).count() == 1


def test_bpe(docs):
    out, t = ids(bpe.bpe_round_trip(docs, PATH)), Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        x = t.encode(text or "", add_special_tokens=False).ids
        y = t.decode(x, skip_special_tokens=False)
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(x), hashlib.sha256(np.array(x, np.uint32).tobytes()).hexdigest(), hashlib.sha256(y.encode()).hexdigest())


def test_bpe_on_odd_characters():
    v, t = bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    rnd = np.random.default_rng(1)
    texts = ["".join(rnd.choice(list("ab sStrelv'' \n\t\x1c\x85\xa0éß1½².<|>中　 \U00018e76"), 25)) for _ in range(3000)] + ["a" * 3000, "1" * 999]
    flat, first = v.cache.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_substring(docs):
    out, owner = ids(substring.remove_substrings(docs)), {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for k in range(len(w) - 12):
            owner.setdefault(tuple(w[k : k + 13]), i)
    for i, t in enumerate(TEXTS):
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if owner[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        assert (out[i].n_removed, out[i].text) == (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_suffix_dedup(docs):
    out, owner = ids(suffix_dedup.remove_repeats(docs)), {}
    raw = [(t or "").encode() for t in TEXTS]
    for i, b in enumerate(raw):
        for k in range(len(b) - 99):
            owner.setdefault(b[k : k + 100], (i, k))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 100, bool)
        for k in range(len(b) - 99):
            if owner[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        gone = gone[: len(b)]
        assert (out[i].n_removed, bytes(out[i].kept)) == (gone.sum(), np.frombuffer(b, np.uint8)[~gone].tobytes())

def mixed_corpus(seed, n):
    """Texts that share passages, lines and repetitions in many contexts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 4)))
    shared = [" ".join(word() for _ in range(k)) for k in (40, 15, 9, 25)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.integers(0, 25)))]
        for _ in range(rng.integers(0, 4)):
            parts += [str(rng.choice(shared)), " ".join(word() for _ in range(rng.integers(0, 20)))]
        if rng.random() < 0.2:
            parts.append(str(rng.choice(["ab ", "ab cd ", "a b c "])) * int(rng.integers(5, 90)))
        out.append(("\n" if rng.random() < 0.5 else "  ").join(parts))
    return out


def earlier_units(texts, span, itself):
    """For each list of units, which are covered by a span that also starts earlier."""
    owner, out = {}, []
    for i, t in enumerate(texts):
        for k in range(len(t) - span + 1):
            owner.setdefault(tuple(t[k : k + span]), (i, k))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if owner[tuple(t[k : k + span])] < ((i, k) if itself else (i, -1)):
                gone[k : k + span] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [(10**6, 10**6), (3, 10**6), (10**6, 2), (1, 2)])
def test_hot_anchors(spark, hot):
    """Hot anchors, by rows in all or by documents of a slice, give what others give."""
    limits = {"hot": hot[0], "locally_hot": hot[1]}
    texts = mixed_corpus(8, 120)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    words_of = [words(t) for t in texts]
    out = ids(substring.remove_substrings(frame, **limits))
    for i, gone in enumerate(earlier_units(words_of, 13, False)):
        assert (out[i].n_removed, out[i].text) == (gone.sum(), " ".join(w for w, g in zip(words_of[i], gone, strict=True) if not g))
    out = ids(suffix_dedup.remove_repeats(frame, **limits))
    for i, gone in enumerate(earlier_units([t.encode() for t in texts], 100, True)):
        assert (out[i].n_removed, bytes(out[i].kept)) == (gone.sum(), np.frombuffer(texts[i].encode(), np.uint8)[~gone].tobytes())


@pytest.mark.parametrize("rows", [1 << 22, 1, 3, 10])
def test_column_wise_construction(rows):
    """Blocks of a few rows: external files. All that share symbols or markers stand together, with the length of what they share."""
    rng = np.random.default_rng(0)
    for _ in range(30):
        left = [bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(rng.integers(1, 9))]
        tails = sorted(bytes(rng.integers(97, 99, 3).tolist()) for _ in left)
        shared = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        common = np.array([0] + [shared(x, y) for x, y in zip(tails[:-1], tails[1:], strict=True)])
        string, reach, got = bcr.sorted_suffixes(lambda s, j: np.array([left[i][-1 - j] for i in s.tolist()], np.uint8), np.array(list(map(len, left))), common, rows)
        text = lambda i, j: left[i][len(left[i]) - j :]
        keys = [(text(i, j), i) for i, j in zip(string.tolist(), reach.tolist(), strict=True)]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)
        for (x, i), (y, k), n in zip(keys[:-1], keys[1:], got[1:].tolist(), strict=True):
            assert n == (len(x) + common[i + 1 : k + 1].min() if x == y else shared(x, y))
        present = set(keys)
        for i, s in enumerate(left):  # a string ends early only where it is alone
            for j in range(len(s) + 1):
                if any(len(t) >= j and t[len(t) - j :] == s[len(s) - j :] for k, t in enumerate(left) if k != i):
                    assert (text(i, j), i) in present


def sharded(docs, shards, path, **more):
    """Rows of shard_documents, held against what the law, the sizes and the map say."""
    out = sharding.shard_documents(docs, shards, path, **more).collect()
    slots, placed = defaultdict(list), defaultdict(set)
    load = dict.fromkeys(range(shards), 0)
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        placed[r.virtual_slot].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    version, count, held = sharding.load_map(docs.sparkSession, path)
    assert count == shards and all(s == {held[v]} for v, s in placed.items())
    return out, load, version, held


def test_sharding(spark, docs):
    path, wide = shared_path(spark, "m"), docs.withColumns({"first": F.lit("mine"), "shard": F.lit("old"), "row": F.lit(1)})
    out, _, version, _ = sharded(wide, 3, path)
    assert len(out) == docs.count() and version == 1 and {r["first"] for r in out} == {"mine"}
    assert sharded(wide, 3, path)[2] == 1  # nothing to edit
    with pytest.raises(ValueError, match="virtual slots"):
        sharding.shard_documents(docs, 3, path, 64)


def brute_shards(rows, shards, slots):
    """(doc_id, text) -> the (shard, slot, virtual slot) of its rows, by the definition: hash, largest slot to the lightest shard, numbers in order."""
    import struct

    import xxhash

    def hashed(i, t):
        h = 42  # of a row, column by column, nulls passed over
        h = h if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), seed=h)
        h = h if t is None else xxhash.xxh64_intdigest(t.encode(), seed=h)
        return (h - (1 << 64) if h >> 63 else h) % slots

    held = defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        held[hashed(i, t)].append(((i is not None, i or 0), zlib.crc32(raw), len(raw) + 8, i, t))
    size = {v: sum(x[2] for x in held.get(v, [])) for v in range(slots)}
    load, count, placed = [0] * shards, [0] * shards, {}
    for v in sorted(range(slots), key=lambda v: (-size[v], v)):
        s = min(range(shards), key=lambda s: (load[s], count[s], s))
        placed[v] = s
        load[s] += size[v]
        count[s] += 1
    out, filled = defaultdict(list), [0] * shards
    for v in range(slots):
        for *_, i, t in sorted(held.get(v, []), key=lambda x: x[:3]):
            out[i, t].append((placed[v], filled[placed[v]], v))
            filled[placed[v]] += 1
    return {k: sorted(x) for k, x in out.items()}


def test_sharding_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i, f"text {i % 7}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in sharding.shard_documents(frame, 5, shared_path(spark, "m"), 64).collect():
        got[r.doc_id, r.text].append((r.shard, r.slot, r.virtual_slot))
    assert {k: sorted(x) for k, x in got.items()} == brute_shards(rows, 5, 64)


def test_rebalancing_keeps_what_it_can(spark):
    path, docs = shared_path(spark, "m"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out, load, _, held = sharded(docs, 24, path)
    largest = max(sum(r.size for r in out if r.virtual_slot == v) for v in {r.virtual_slot for r in out})
    assert len(out) == docs.count() and max(load.values()) - min(load.values()) <= largest
    total = sum(load.values())
    for shards, version in ((25, 2), (8, 3), (24, 4)):
        _, load, found, edited = sharded(docs, shards, path, tolerance=0.05)
        assert found == version and max(load.values()) <= 1.06 * total / shards + largest
        stay = sum(edited[v] == held[v] for v in held if held[v] < shards) / max(1, sum(held[v] < shards for v in held))
        assert stay > 0.9
        held = edited
    assert sharding.load_map(spark, path, 2)[1] == 25  # older versions stay


def test_chat(spark):
    hard = [r"\### Assistant: </turn> ok", "<turn assistant>", r"\l\b\\g", "", None, "ü\n>"]
    rows = [(c, t, "assistant" if t % 2 else "user", hard[(c + t) % 6]) for c in range(6) for t in range(c + 1)] + [(9, 0, None, "x"), (9, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.conversation_digests(chat.chat_examples(turns)).collect()}
    for c in {r[0] for r in rows}:
        mine = [(role or "", text or "") for k, _, role, text in rows if k == c]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (out[c].n_turns, out[c].loss_chars, out[c].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_licenses(docs, spark):
    found = {(r.doc_id, r.license): r for r in licenses.license_scan(docs).collect()}
    assert set(found) == {(14, "mit-line")} and found[14, "mit-line"].begin == 0
    near = spark.createDataFrame([(1, licenses.TEMPLATES["apache-2.0-header"].replace("governing", "that governs"))], "doc_id long, text string")
    got = {r.license: r.coverage for r in licenses.license_scan(near).collect()}
    assert got["apache-2.0-line"] == 1.0 and 0.95 < got["apache-2.0-header"] < 1.0


def plain_alignment(template, text, d, band=8):
    """The best of all alignments in the band around one diagonal: most words, then latest begin, then earliest end; by the definition, cell by cell."""
    best = {}
    for i, word in enumerate(template):
        for j in range(max(0, i + d - band), min(len(text), i + d + band + 1)):
            options = [best.get((i - 1, j), (0, 0, 0)), best.get((i, j - 1), (0, 0, 0)) if j - 1 >= i + d - band else (0, 0, 0)]
            if text[j] == word:
                n, first, _ = best.get((i - 1, j - 1), (0, 0, 0))
                options.append((n + 1, first if n else j, -j))
            best[i, j] = max(options)
    n, first, last = max(best.values(), default=(0, 0, 0))
    return n, first, -last


def every_alignment(template, text, least=0.8):
    """Best alignment over all diagonals from the first that matches, then what lies before and behind it."""
    found = [(d, plain_alignment(template, text, d)) for d in range(-len(template) - 8, len(text) + 9)]
    good = [(d, x) for d, x in found if x[0] > 0 and x[0] >= least * len(template)]
    if not good:
        return []
    n, a, b = max((x for d, x in good if d <= good[0][0] + 16), key=lambda x: x[0])
    return every_alignment(template, text[:a], least) + [(n, a, b)] + [(m, b + 1 + x, b + 1 + y) for m, x, y in every_alignment(template, text[b + 1 :], least)]


def test_license_alignment_everywhere(spark):
    lines = ["Released under an MIT License", "Released under the MIT License. x Released x under the x MIT License", "Licensed under CC BY-SA 4.0 . Licensed under CC BY NC four 0", "all rights rights reserved; All Rights Reserved", "x the the the the MIT under", None, ""]
    rng = np.random.default_rng(3)
    vocabulary = "released under the mit license licensed cc by nc 4 0 all rights reserved x y".split()
    lines += [" ".join(rng.choice(vocabulary, rng.integers(1, 50))) for _ in range(150)]
    few = {k: licenses.TEMPLATES[k] for k in ("mit-line", "cc-by-nc-4.0", "all-rights-reserved")}
    out = licenses.license_scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), few).collect()
    spans, number = [], {}
    code = lambda t: list([number.setdefault(w, len(number)) for w in re.findall("[a-z0-9]+", (t or "").lower())])
    for i, t in enumerate(lines):
        at = [m.span() for m in re.finditer("[a-z0-9]+", (t or "").lower())]
        spans += [(i, name, n, at[a][0], at[b][1]) for name, line in few.items() for n, a, b in every_alignment(code(line), code(t))]
    assert sorted((r.doc_id, r.license, r.matched_words, r.begin, r.end) for r in out) == sorted(spans)
    assert (0, "mit-line", 4, 0, len(lines[0])) in spans and sum(x[:2] == (1, "mit-line") for x in spans) == 2


def test_license_fingerprints_meet_every_match():
    """Whatever words a match lacks, it has one of the fingerprints."""
    rng = np.random.default_rng(5)
    names, units, _, _, prints = licenses.template_index(licenses.TEMPLATES, 0.8)
    for t, unit in enumerate(units):
        own = [place for found in prints for x, place in found if x == t]
        lacks = len(unit) - licenses.needed(unit, 0.8)
        assert len(set(own)) == lacks + 1, names[t]
        for _ in range(20):
            gone = set(rng.choice(len(unit), lacks, replace=False).tolist())
            assert set(own) - gone


def test_slices_without_a_template_word(spark):
    """Tables, partitions and slices of which no text has any word of a template match nothing, and what lies beside them is found."""
    none = [(1, "la maison est grande"), (2, None), (3, "")]
    for rows in (none[:1], none[1:], none):
        assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).count() == 0
    line, long = "Released under the MIT License.", "x" * SLICE_BYTES  # a long text and the one after it are slices of their own
    mixed = spark.createDataFrame([(4, f"{line} {long}"), (5, "la maison"), (6, long), (7, line)], "doc_id long, text string")
    for parts in (1, 4):
        found = licenses.license_scan(mixed.coalesce(1) if parts == 1 else mixed.repartitionByRange(parts, "doc_id")).collect()
        assert sorted((r.doc_id, r.license, r.matched_words, r.begin, r.end) for r in found) == [(i, "mit-line", 5, 0, len(line) - 1) for i in (4, 7)]


def test_long_text_of_repeated_lines(spark):
    text = "Released under the MIT License. " * 4000
    out = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(out) == 4000 and {r.license for r in out} == {"mit-line"} and {r.matched_words for r in out} == {5}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, BASE[:90].upper()), (2, "short"), (3, None), (4, "--"), (1, BASE[:90])], "item_id long, text string")
    out = ids(decontaminate.contamination(docs, bench))
    assert out[4].contaminated and out[3].n_items == 1 and out[3].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert not out[10].contaminated and out[0].n_words == 0
    assert decontaminate.decontaminate(docs, bench).where("doc_id IN (3, 4, 5)").count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("found", "hits", "n_words", "doc_words", "row")})
    assert decontaminate.decontaminate(clash, bench).columns == clash.columns


def test_decontamination_against_brute_force(spark):
    """Phrases and proximity, with repeated words, short items and terms that are equally rare."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "x-y"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(n)) for k, n in enumerate([3, 8, 12, 15, 1, 14, 11])] + [(7, "w1 w1 w1 w2"), (8, "not in the corpus")]
    texts = [text(rng.integers(0, 80)) + (" " + items[rng.integers(0, 7)][1] if rng.random() < 0.4 else "") + " " + text(5) for _ in range(60)]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = ids(decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    count, windows = defaultdict(int), defaultdict(set)
    for w in (w for t in texts for w in cut(t)):
        count[w] += 1
    for k, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - 9)):
            windows[tuple(w[i : i + 10])].add(str(k))
    for d, t in enumerate(texts):
        w, hit, found, near = cut(t), set(), set(), 0
        for v, of in windows.items():
            for i in range(len(w) - len(v) + 1):
                if tuple(w[i : i + len(v)]) == v:
                    hit.update(range(i, i + len(v)))
                    found |= of
            rare = {v[j] for j in sorted(range(len(v)), key=lambda j: (count[v[j]], j))[:3]}  # noqa: B023
            near += all(count[x] for x in v) and any(rare <= set(w[i : i + 13]) for i in range(len(w)))
        r = out[d]
        assert (r.n_words, r.n_hit, r.n_items, r.n_near) == (len(w), len(hit), len(found), near)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert quality.quality_rules(none).count() == ngram_join.jaccard_components(none).count() == substring.remove_substrings(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == licenses.license_scan(none).count() == bpe.bpe_encode(none, PATH).count() == 0
    path = shared_path(spark, "e")
    token_files.write_tokens(none, path, PATH, 2)
    assert token_files.read_tokens(spark, path).count() == 0
    assert sharding.shard_documents(none.select("doc_id", "text"), 3, shared_path(spark, "m")).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(docs, bench).where("contaminated").count() == 0
    assert chat.chat_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_pipeline(rows, items):
    """doc_id and ids of what the five stages keep of (doc_id, text)."""
    kept = []
    for i, t in rows:
        w, lines = words(t), defaultdict(int)
        for k in range(len(w) - 7):
            lines[tuple(w[k : k + 8])] += 1
        covered = {j for k in range(len(w) - 7) if lines[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        chars, longest = sum(map(len, w)), 0
        while any(n > 1 for n in counted_windows(w, max(8, longest + 1)).values()):
            longest = max(8, longest + 1)
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and sum(len(w[j]) for j in covered) <= 0.3 * chars and longest <= max(200, 0.25 * len(w)):
            kept.append((i, t))
    sets = [set(counted_windows(words(re.sub("[A-Z]", lambda m: m[0].lower(), t)), 5)) for _, t in kept]
    label = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if kept[a][0] is not None and kept[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    stay = [k for k in range(len(kept)) if kept[k][0] is None or k == min((j for j in range(len(kept)) if label[j] == label[k] and kept[j][0] is not None), key=lambda j: (kept[j][0], j))]
    kept = [kept[k] for k in stay]
    owner, out = {}, []
    for i, t in kept:
        for k in range(len(b := t.encode()) - 99):
            if i is not None:
                owner[b[k : k + 100]] = min(owner.get(b[k : k + 100], (i, k)), (i, k))
    for i, t in kept:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if i is not None and owner[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        if left := np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"):
            out.append((i, left))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bad = [tuple(w[k : k + 10]) for _, t in items if (w := cut(t)) for k in range(max(1, len(w) - 9))]
    clean = [(i, t) for i, t in out if not any(tuple(w[k : k + len(v)]) == v for w in [cut(t)] for v in bad for k in range(len(w) - len(v) + 1))]
    library = Tokenizer.from_file(PATH)
    return sorted((str(i), library.encode(t, add_special_tokens=False).ids) for i, t in clean)


def counted_windows(w, n):
    out = defaultdict(int)
    for k in range(len(w) - n + 1):
        out[tuple(w[k : k + n])] += 1
    return out


def test_pipeline_against_brute_force(spark):
    """All stages over whole tables with null, empty and long texts, copies, near copies, repeated rows and ids, and more columns."""
    import corpus_pipeline

    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(90)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(500 + k, t) for k, t in enumerate(TEXTS[:-4]) if t != LONG] + rows[3:6] + [(501, rows[7][1] + " more"), (7, rows[8][1]), (600, LONG[:9000]), (601, LONG[2000:7000] + rows[9][1]), (602, " ".join(dict.fromkeys(BASE.split())) + " é" * 3 + LONG[9000:9900])]
    items = [(1, " ".join(rows[12][1].split()[4:18])), (2, BASE.upper()), (3, None)]
    folder = shared_path(spark, "small")
    spark.createDataFrame([(i, t, "en", "s", 0, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, rest string, kept long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert sorted((str(r.doc_id), list(r.ids)) for r in out.collect()) == brute_pipeline(rows, items)
    assert all(r.n_tokens == len(r.ids) for r in out.collect()) and out.columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    folder = shared_path(spark, "none")
    for name, schema in (("documents", "doc_id long, text string"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_very_long_texts(spark):
    """One text beyond any batch: every operator takes it whole."""
    rng = np.random.default_rng(9)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghié"), 6)) for _ in range(5000)])
    big = " ".join(rng.choice(vocabulary, 1_300_000))
    size, cut = len(big.encode()), len(big) // 2
    assert size > 9_000_000
    texts = {1: big, 2: "short and new " * 3, 3: big[cut:] + " and what comes behind it"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    n = {i: len(words(t)) for i, t in texts.items()}
    assert {i: r.n_words for i, r in ids(quality.quality_rules(docs)).items()} == n
    assert {i: r.component_id for i, r in ids(ngram_join.jaccard_components(docs)).items()} == {1: 1, 2: 2, 3: 3}
    tail = len(words(big[cut:])) - (big[cut - 1] != " ")
    found = ids(substring.substring_digests(docs))
    assert found[1].n_removed == found[2].n_removed == 0 and abs(found[3].n_removed - tail) <= 1
    found = ids(suffix_dedup.repeat_digests(docs))
    assert found[1].n_removed == found[2].n_removed == 0 and found[3].n_removed == len(big[cut:].encode()) and found[3].n_spans == 1
    library = Tokenizer.from_file(PATH)
    expected = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    path = shared_path(spark, "t")
    token_files.write_tokens(docs, path, PATH, 2)
    assert {r.doc_id: r.ids_crc32 for r in token_files.token_digests(token_files.read_tokens(spark, path)).collect()} == {i: zlib.crc32(np.array(x, np.uint32).tobytes()) for i, x in expected.items()}
    assert {i: r.ids_sha256 for i, r in ids(bpe.bpe_round_trip(docs, PATH)).items()} == {i: hashlib.sha256(np.array(x[:-1], np.uint32).tobytes()).hexdigest() for i, x in expected.items()}
    bench = spark.createDataFrame([(1, " ".join(words(big)[-12:]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()} == {1, 3}
    assert licenses.license_scan(docs.withColumn("text", F.concat("text", F.lit(" Released under the MIT License.")))).count() == 3
    assert sum(r.size for r in sharding.shard_documents(docs, 3, shared_path(spark, "m")).collect()) == sum(len(t.encode()) + 8 for t in texts.values())


def test_dictionary_of_every_table(spark, docs):
    """Few and short documents have a dictionary too, and one document is read alone."""
    for rows in ([(1, "a b c d e f g")], [(i, BASE) for i in range(40)], [(i, t) for i, t in enumerate(TEXTS)]):
        path = shared_path(spark, "t")
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, 2)
        dictionary, sha = token_files.read_dictionary(spark, path)
        assert dictionary and {r.dictionary_sha256 for r in spark.read.parquet(f"{path}/blocks").collect()} == {sha}
        assert token_files.read_tokens(spark, path, rows[-1][0]).count() == 1


def test_clashing_columns(spark, docs):
    """Columns named like those that the operators make."""
    clash = docs.withColumns({c: F.lit("x") for c in ("hash", "hashes", "hot", "ranges", "range_id", "rest", "n_removed", "text_hash", "kept")})
    assert quality.quality_filter(clash).columns == clash.columns
    assert set(substring.remove_substrings(clash).select("rest.*").columns) == set(suffix_dedup.remove_repeats(clash).select("rest.*").columns) == set(clash.columns) - {"doc_id", "text"}
    assert bpe.bpe_encode(clash, PATH).count() == licenses.license_scan(clash.withColumn("text", F.lit("Released under the MIT License."))).count() == docs.count()
    turns = spark.createDataFrame([(1, 0, "user", "u", "x", "y"), (1, 1, "assistant", "a", "x", "y")], "conv_id long, turn long, role string, text string, formatted string, target string")
    assert chat.chat_examples(turns).count() == 1


def test_whole_table_against_the_tokenizers_library(spark):
    """op3 and op4 as they are registered, over all documents of sf0.01."""
    from tablewright.llm import queries

    d = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    library = Tokenizer.from_file(PATH)
    at, three, four = 0, [], []
    for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        x = np.array([*e.ids, 2], np.uint32)
        three.append((i, at, len(x), zlib.crc32(x.tobytes())))
        decoded = library.decode(e.ids, skip_special_tokens=False)
        four.append((i, len(x) - 1, hashlib.sha256(x[:-1].tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        at += len(x)
    assert sorted(map(tuple, queries.op3_token_files(spark, d).collect())) == three
    assert sorted(map(tuple, queries.op4_bpe(spark, d).collect())) == four
