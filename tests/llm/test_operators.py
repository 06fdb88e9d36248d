"""The training-data operators against brute force, on a fixture of awkward rows and on sf0.001."""

import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF, same_rows
from factloom.llm import queries as q

LINE = "A shared line that is long enough"
ROWS = [
    (1, None), (2, ""), (3, "one"), (4, "a b c d e"), (5, f"{LINE}\nfive"), (6, f"  {LINE.upper()} \nsix"), (7, f"{LINE}\n{LINE}\nseven"), (8, f"eight\n{LINE}\t"),
    (9, "copy of a text with some words in it"), (10, "copy of a text with some words in it"), (10, "copy of a text with some words in it"), (None, "no id here at all"),
    (11, "x y z w v " * 400), (12, "ÁÉ ñandú x <|endoftext|> it's 12\n\n  end "), (13, " \t\n"), (14, "word " * 30_000),
]
IDS = [r for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "mine") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def table():
    frame = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return {i: t or "" for i, t in zip(frame.doc_id, frame.text, strict=True)}


@pytest.mark.parametrize("name", ["op7_line_dedup", "op9_exact_dedup", "op10_quality_rules"])
def test_native_against_duckdb(spark, duck, name):
    ours, theirs = q.queries()[name](spark, SF).toPandas(), duck.sql(q.oracle_sql()[name]).df()
    assert same_rows(ours, theirs, sorted(theirs.columns))


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_line_dedup_awkward(docs, empty):
    from factloom.llm.line_dedup import line_dedup

    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(docs).collect())
    expected = Counter()
    for i, t in ROWS:
        lines, kept, dropped = (t or "").split("\n"), [], 0
        for line in lines:
            if fold(line.strip(" \t\n\x0b\x0c\r")) == LINE.lower() and i != 8:
                dropped += 1
            else:
                kept.append(line)
        expected[i, "\n".join(kept), len(lines), dropped] += 1
    assert got == expected and line_dedup(empty).count() == 0


def test_exact_dedup_awkward(docs, empty):
    from factloom.llm.exact_dedup import exact_dedup

    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs, bitmap_bits=1 << 16).collect()]
    assert Counter(rows)[9, 10, 3, False] == 1 and Counter(rows)[10, 10, 3, True] == 1 and Counter(rows)[10, 10, 3, False] == 1
    assert Counter(rows)[1, 2, 2, False] == 1 and Counter(rows)[None, None, 1, True] == 1 and len(rows) == len(ROWS)
    assert exact_dedup(empty).count() == 0


def test_quality_rules_awkward(docs, empty):
    from factloom.llm.quality_rules import ablations, apply_policy, rule_ledger

    ledger = rule_ledger(docs)
    by_id = {r["doc_id"]: r for r in ledger.collect()}
    assert by_id[1]["n_words"] == by_id[13]["n_words"] == 0 and by_id[14]["n_repeat_words"] == 30_000 and by_id[7]["n_dup_lines"] == 1
    assert apply_policy(ledger, "2024.1").where("kept").count() <= apply_policy(ledger, "base").where("kept").count()
    assert ablations(ledger, "base").count() == 2 and rule_ledger(empty).count() == 0


@pytest.mark.parametrize("hot_cell", [64, 1])
def test_simhash(spark, docs, empty, table, hot_cell):
    from factloom.llm.simhash import near_dedup

    def prints(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        counts = np.zeros(64, int)
        for s, n in Counter(shingles).items():
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            counts += n * np.array([h >> b & 1 for b in range(64)])
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))

    for frame, rows in ((docs, ROWS), (spark.read.parquet(f"{SF}/documents.parquet"), list(table.items()))):
        fps = [prints(t) for _, t in rows]
        group = list(range(len(rows)))
        for i, a in enumerate(fps):
            for j, b in enumerate(fps[:i]):
                if (a ^ b).bit_count() <= 2 and group[i] != group[j]:
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
        ids = {}
        for (i, _), g in zip(rows, group, strict=True):
            ids[g] = min((x for x in (ids.get(g), i) if x is not None), default=None)
        expected = Counter((i, fp - (1 << 64) if fp >> 63 else fp, ids[g]) for (i, _), fp, g in zip(rows, fps, group, strict=True))
        assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in near_dedup(frame, hot_cell=hot_cell).collect()) == expected
    assert near_dedup(empty).count() == 0


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(q.tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


ODD = ["", "  ", "a  b", "<|endoftext|>x <|startoftext|> y", "İstanbul ΣΑΣ ς", "x́y é", "it's I'LL", "tab\tsep\n\n  x \n y", "12 3½ ٣", "日本語", "\x1c a\x1db", "end ", " nb  sp", "</w> a</w>b", "😀 👨‍👩‍👧", "a" * 300, "\n \nb", "  x  \t y "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders(libraries, table, name):
    from factloom.llm.bpe_trie import codec
    from factloom.llm.tokenizing import library_encoder

    texts = ODD + list(table.values())
    wanted = [np.array(e.ids, "<u4").tobytes() for e in libraries[name].encode_batch(texts, add_special_tokens=False)]
    assert library_encoder(q.tokenizer_path(name))(texts) == wanted
    if name.startswith("word"):
        own = codec(q.tokenizer_path(name))
        assert own.encode_texts(texts) == wanted
        assert [own.decode(w) for w in wanted] == [libraries[name].decode(np.frombuffer(w, "<u4").tolist(), skip_special_tokens=False) for w in wanted]


def test_plain_latin_texts(libraries):
    from factloom.llm.bpe_trie import codec
    from factloom.llm.tokenizing import library_encoder

    path, lib, rng = q.tokenizer_path("word_bpe_49k.json"), libraries["word_bpe_49k.json"], np.random.default_rng(3)
    texts = [t for c in map(chr, [*range(0x260), 0x2014, 0x2019]) for t in (c, f"a{c}b", f"1{c}{c}2", f"Ab {c}'S x{c}'ll_{c}.", f"{c}́")]
    letters = [*map(chr, [9, 10, 13, 28, 0x85, *range(32, 127), *range(0xA0, 0x250)]), *"'''sstrevemlld  __<|>" * 6]
    texts += ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(2000)]
    texts += ["ab" * 20_000, "q" * 50_000, "a" * 63 + "b", "a" * 64 + "b", "a" * 65 + "b"]
    wanted = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert codec(path).encode_texts(texts) == wanted and library_encoder(path)(texts) == wanted


def test_plain_latin_bytes(libraries):
    from factloom.llm.tokenizing import library_encoder

    path, lib, rng = q.tokenizer_path("byte_bpe_50k.json"), libraries["byte_bpe_50k.json"], np.random.default_rng(3)
    texts = [t for c in map(chr, [*range(0x310), *range(0x2000, 0x2070), 0x3000, 0x660]) for t in (c, f"a{c}b", f"1{c}{c}2", f"Ab {c}'S x{c}'ll_{c}.", f" {c} {c} a", f"{c}\n{c}  x")]
    letters = [*map(chr, [9, 10, 13, 28, 0x85, *range(32, 127), *range(0xA0, 0x300), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]), *"'''sstrevemlld  __<|>" * 6, *" \n" * 30]
    texts += ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)] + ["ab" * 20_000, "q" * 50_000]
    assert library_encoder(path)(texts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_chunk_cache_generations():
    from factloom.llm.tokenizing import ChunkCache

    asked = []
    cache = ChunkCache(lambda chunks: asked.extend(chunks) or [c.encode() for c in chunks], 4)
    for chunks in ({"a", "b", "c"}, {"d", "e"}, {"a", "e"}, {"f", "g", "h"}, {"a"}, {str(i) for i in range(9)}):
        cache.learn(chunks)
        assert all(cache.known[c] == c.encode() for c in chunks)
    assert asked.count("a") == 1 and len(cache.known) <= 9


@pytest.mark.parametrize(("longest", "whole"), [(60, 0.7), (700, 0.85), (2048, 0.85), (9000, 0.85)])
def test_bins(longest, whole):
    from factloom.llm.packing import Bins, Piece, size_of

    rng = np.random.default_rng(longest)
    lengths = rng.integers(1, longest + 1, 3000).tolist()
    bins = Bins(2048)
    full = [x for i, n in enumerate(lengths) for x in bins.add(Piece(i, b"", 0, n))]
    last = list(bins.close())
    assert all(size_of(x) == 2048 for x in full) and all(size_of(x).bit_count() == 1 for x in last) and sum(size_of(x) < 2048 for x in last) <= 11
    pieces = sorted((p.doc, p.start, p.length) for x in full + last for p in x)
    ends = [0] * len(lengths)
    for doc, start, length in pieces:
        assert start == ends[doc] and length > 0
        ends[doc] += length
    assert ends == lengths
    count = Counter(p[0] for p in pieces)
    short = [i for i, n in enumerate(lengths) if n <= 2048]
    assert sum(count[i] == 1 for i in short) >= whole * len(short)
    assert not list(Bins(2048).close())


def test_trie_equals_merging():
    from factloom.llm.bpe_trie import TrieBpe

    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "a"), ("ab", "ab"), ("aa", "b</w>"), ("b", "c</w>")]
    letters = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    vocab = {t: i for i, t in enumerate(letters + [x + y for x, y in merges])}
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(500)}
    found = TrieBpe(vocab, merges, "</w>").encode(words)
    for word in words:
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        assert [vocab[p] for p in parts] == list(found[word]), word


def test_packing(docs, empty, libraries):
    from factloom.llm.packing import pack

    path = q.tokenizer_path("byte_bpe_50k.json")
    rows = pack(docs, path).collect()
    ids = {i: [*libraries["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids, 1] for i, t in IDS}
    seen, ends = Counter(), {}
    for r in rows:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        if r["doc_id"] is not None:
            assert own == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
            seen[r["doc_id"]] += r["length"]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(own) == r["length"]
    assert seen == {i: len(ids[i]) * Counter(x for x, _ in IDS)[i] for i in ids}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and pack(empty, path).count() == 0


def test_bpe_and_counts(spark, docs, empty, libraries, tmp_path):
    from factloom.llm.bpe_trie import bpe_decode, bpe_encode
    from factloom.llm.token_counts import token_counts

    path, lib = q.tokenizer_path("word_bpe_49k.json"), libraries["word_bpe_49k.json"]
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in IDS}
    for r in bpe_decode(bpe_encode(docs, path), path).where("doc_id is not null").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]] and r["decoded"] == lib.decode(ids[r["doc_id"]], skip_special_tokens=False)
    cache = f"file://{tmp_path}/cache"
    expected = sorted((i, len((t or "").encode()), len(ids[i]), len(ids[i]) > 2048) for i, t in IDS)
    for _ in range(2):  # the second time from the cache
        rows = token_counts(docs, path, cache).where("doc_id is not null").collect()
        assert sorted(map(tuple, rows)) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts(empty, path, cache).count() == 0 and bpe_encode(empty, path).count() == 0


def test_lm(spark, docs, empty, table):
    from factloom.llm.ngram_lm import discounts_of, score_lm, train_lm

    for frame, rows in ((docs, ROWS), (spark.read.parquet(f"{SF}/documents.parquet"), list(table.items()))):
        lines = [["\n\n", *re.findall(r"[^\x20\x09-\x0D]+", fold(t or "")), "\n"] for _, t in rows]
        one, two = Counter(w for x in lines for w in x[1:]), Counter(p for x in lines for p in zip(x, x[1:], strict=False))
        follows, total, spare = Counter(b for _, b in two), Counter(), Counter()
        classes = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        d, low = discounts_of(classes(two)), discounts_of(classes(follows))
        for (a, _), c in two.items():
            total[a] += c
            spare[a] += d[min(c, 3) - 1]
        rest = sum(low[min(c, 3) - 1] for c in follows.values()) / len(two) / (len(one) + 1)
        lower = lambda w: (follows[w] - low[min(follows[w], 3) - 1]) / len(two) + rest  # noqa: E731,B023
        p = lambda a, b: (two[a, b] - d[min(two[a, b], 3) - 1] if two[a, b] else 0) / total[a] + spare[a] / total[a] * lower(b)  # noqa: E731,B023
        n, v = sum(one.values()), len(one)
        model = train_lm(frame)
        assert (model.tokens, model.words) == (n, v)
        expected = sorted((str(i), len(x) - 1, round(sum(np.log10((one[w] + 1) / (n + v + 1)) for w in x[1:]), 4), round(sum(np.log10(p(a, b)) for a, b in zip(x, x[1:], strict=False)), 4)) for (i, _), x in zip(rows, lines, strict=True))
        got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in score_lm(frame, model).collect())
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert np.allclose([g[2:] for g in got], [e[2:] for e in expected], atol=2e-3)
        assert abs(sum(p("\n\n", w) for w in one) + spare["\n\n"] / total["\n\n"] * rest - 1) < 1e-9
    assert train_lm(empty).tokens == 0 and score_lm(empty, model).count() == 0
    assert score_lm(docs, train_lm(empty)).where("score <> 0").count() == 0


def auc(score, y):
    ranks = np.argsort(np.argsort(score, kind="stable")) + 1
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.85), ("op2_quality_gam", "quality", 0.97)])
def test_classifiers_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    scored = q.queries()[name](spark, sf).toPandas().merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    out = scored[scored.held_out]
    assert auc(out.score.to_numpy(), (out[label] == 1).to_numpy()) >= least and scored.score.between(0, 1).all()


def test_classifiers_awkward(spark, docs, empty):
    from factloom.llm.quality_model import fit_quality, score_quality
    from factloom.llm.toxicity import fit_toxicity, score_toxicity

    labels = spark.createDataFrame([(3, 1, 0), (4, None, None), (None, 1, 1), (9, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false"), labels.where("doc_id = 3")):
        for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
            model = fit(docs, lab, F.lit(True))
            rows = score(docs, model).collect()
            assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
            assert score(empty, model).count() == 0


def test_levenshtein_trie_against_distances():
    from factloom.llm.toxicity import Entry, LevenshteinTrie

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(1500):
        words = ["".join(rng.choice(list("abc"), rng.integers(5, 9))) for _ in range(5)]
        searched = "".join(rng.choice(list("abc"), rng.integers(4, 10)))
        found = LevenshteinTrie({w: Entry(5.0, 1.0) for w in words}).search(searched, 1)
        assert (found is not None) == any(distance(searched, w) <= 1 for w in words)
        assert found is None or distance(searched, found[0]) <= 1


def test_near_copies_against_exact_similarity(spark):
    from factloom.llm.near_copies import near_components

    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 4, 12, 60, 300, 1500):
        for copies in (1, 4, 12):
            words = [f"w{i}" for i in rng.integers(0, 5000, size)]
            for k in range(copies + 1):
                changed = list(words)
                for i in rng.choice(size, min(size, k * size // 150 + (k > 0) * (size > 50)), replace=False):
                    changed[i] = f"new{rng.integers(1 << 30)}"
                rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (None, "no id")]
    words = [f"h{i}" for i in range(200)]
    rows += [(10_000 + k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(60)]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(1, len(w) - 4))}
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for (i, _), g in zip(rows, group, strict=True):
        ids[g] = min((x for x in (ids.get(g), i) if x is not None), default=None)
    expected = {i: ids[g] for (i, _), g in zip(rows, group, strict=True)}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limits in ({}, {"small": 2, "middle": 8}):
        assert {r["doc_id"]: r["component_id"] for r in near_components(frame, **limits).collect()} == expected
    assert len(set(expected.values())) < len(rows) / 2 and near_components(frame.where("false")).count() == 0


def test_covered_words_stay_sought():
    from factloom.llm.toxicity import lexicon_of

    # the beginning stands in more toxic documents, the word in no clean one
    lexicon = lexicon_of({"loser": 93, "^lose": 93, "losers": 80}, {"^lose": 12, "losers": 12}, 319, 2578)
    assert lexicon.match("loser")[2] == 0 and lexicon.match("loser")[1] > 7
    assert lexicon.match("losers")[2] == 1  # says no more than its beginning
    for word in ("looser", "lo5er", "lser"):
        assert lexicon.match(word)[2] == 2, word


def test_every_long_word_is_sought():
    from factloom.llm.toxicity import Entry, Lexicon

    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abcdefghij"), rng.integers(5, 13))): Entry(2.6, 1.1) for _ in range(600)}
    lexicon = Lexicon(words, {}, words)
    for word in words:
        assert lexicon.match(word[:2] + "#" + word[3:])[2] == 2, word


def test_levenshtein_trie_with_two_edits():
    from factloom.llm.toxicity import Entry, LevenshteinTrie

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = np.random.default_rng(6)
    for k in range(1500):
        words = {"".join(rng.choice(list("abcd"), rng.integers(5, 12))): Entry(5.0, 1.0 + i) for i in range(6)}
        searched = "".join(rng.choice(list("abcd"), rng.integers(4, 13)))
        errors = 1 + k % 2
        found = LevenshteinTrie(words).search(searched, errors)
        near = [w for w in words if distance(searched, w) <= errors]
        assert (found and found[0]) == max(near, key=lambda w: words[w].weight, default=None)
    trie = LevenshteinTrie({w: Entry(5.0, 1.0) for w in ("disgusting", "worthless")})
    for word in ("idsgusting", "vvorthless", "owrthless"):
        assert trie.search(word, 2), word


def test_near_copies_meet_in_the_grid():
    from factloom.llm import near_copies as m
    from factloom.llm.simhash import SEGMENTS, majority

    rng = np.random.default_rng(12)
    some = lambda k: rng.integers(0, 1 << 63, k, np.uint64)
    for k in (0, 1, 2, 255, 256, 5000):
        own = some(k)
        prints = m.prints_of(own)
        assert int(prints[0]) == majority(own) and len(prints) == m.WORDS
    pair = lambda p: [int(p) >> 2 * i & 3 for i in range(SEGMENTS)]
    for p in prints:
        assert pair(m.embedded(prints[prints == p])[0]) == [(0, 1, 1, 3)[v] for v in pair(p)]
    # pairs at the similarity, each of ten shingles in nine changed: near, and together in a cell for any number of nodes
    sets = [(both := some(160), np.concatenate([both, some(20)]), np.concatenate([both, some(20)])) for _ in range(1500)]
    x, y = (np.array([m.prints_of(s[i]) for s in sets]) for i in (1, 2))
    assert (np.bitwise_count(x ^ y).sum(axis=1, dtype=int) <= m.radius(0.8, 64 * m.WORDS)).all()
    for nodes in (10, 200_000, 12_000_000):
        masks = m.grid(nodes, 0.8, 2048)
        met = np.any([((m.embedded(x) & k) == (m.embedded(y) & k)).all(axis=1) for k in masks], axis=0)
        assert met.mean() >= 0.99, nodes


def test_cells_and_families_against_loops():
    from factloom.llm import near_copies as m

    rng = np.random.default_rng(13)
    limit = m.radius(0.8, 64 * m.WORDS)
    for k in range(12):
        base = rng.integers(0, 1 << 63, (12, m.WORDS), np.uint64)
        noise = np.bitwise_and.reduce(rng.integers(0, 1 << 63, (2 + k % 3, 300, m.WORDS), np.uint64))
        n, prints = np.sort(rng.integers(20, 60, 300)), base[rng.integers(0, 12, 300)] ^ noise
        group = np.arange(300)
        for i in range(300):
            for j in range(i):
                if n[j] >= 0.8 * n[i] and np.bitwise_count(prints[i] ^ prints[j]).sum() <= limit and group[i] != group[j]:
                    group[group == max(group[i], group[j])] = min(group[i], group[j])
        assert (m.neighbours(n, prints, 0.8) == group).all()
    # a dense family, only some of whose pairs are links
    for size in (3, 12, 60):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(size) < 0.9], rng.integers(0, 1 << 63, rng.integers(1, 3 + size // 20), np.uint64)])) for _ in range(120)]
        group = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                shared = len(np.intersect1d(a, sets[j]))
                if shared >= 0.8 * (len(a) + len(sets[j]) - shared) and group[i] != group[j]:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
        assert len(set(group)) > 1
        assert m.linked(sets, 0.8, 2) == m.linked(sets, 0.8, 1000) == group
