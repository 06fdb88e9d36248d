"""Whole operators against brute force: scores of both classifiers, clashing column names, and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF

BLANKS = " \t\n\x0b\x0c\r"
CLASHING = ["__id", "__text", "__th", "__slot", "__kept", "id", "th", "c0", "c1", "node", "fp", "copies", "digest", "wanted", "Score", "N_lines", "kept"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_toxicity_against_brute_force():
    from factloom.llm import toxicity as t

    lexicon = t.lexicon_of(
        {"awful": 40, "worthless": 60, "^wort": 70, "disgusting": 30, "idiot": 50, "^idio": 45, "it": 80, "bad2": 30},
        {"awful": 2, "worthless": 1, "^wort": 9, "idiot": 3, "^idio": 3, "it": 900},
        100,
        1000,
    )
    assert "it" not in lexicon.words and {"worthless", "disgusting", "idiot", "awful", "bad2"} <= set(lexicon.sought)
    model = t.ToxicityModel(lexicon, np.random.default_rng(0).normal(size=t.FEATURES + 1) / 3)
    pool = "awful AWFUL! awfl awfull wortless vvorthless owrthless worthlss idiot idiots idi0t disgusting idsgusting disgustng bad2 bad3 said \"well» the of plain words 12 ' - ñandú".split()
    rng = np.random.default_rng(1)
    texts = ["", " ", "plain", *(" ".join(rng.choice(pool, rng.integers(1, 120))) for _ in range(150))]

    def hit(chunk):
        w = t.bare(chunk)
        if w in lexicon.words:
            return (lexicon.words[w].z, lexicon.words[w].weight, 0)
        starts = [e for b, e in lexicon.beginnings.items() if w.startswith(b) and len(w) > len(b)]
        if starts:
            best = max(starts, key=lambda e: e.z)
            return (best.z, best.weight, 1)
        errors = t.EDITS if len(w) >= t.TWO_FROM else 1
        near = [e for x, e in lexicon.sought.items() if len(w) >= 4 and len(x) >= t.LEAST_LETTERS and x.isalpha() and distance(w, x) <= errors]
        return (0.7 * max(near, key=lambda e: e.weight).z, 0.7 * max(e.weight for e in near), 2) if near else None

    def features(text):
        words = text.split()
        hits = [(i, *h) for i, w in enumerate(words) if (h := hit(w))]
        if not hits:
            return [0.0] * (t.FEATURES - 1) + [np.log1p(len(words))]

        def in_quotes(i):
            mark = lambda some: any(c in t.QUOTES for w in some for c in w)
            around = mark(words[max(0, i - t.WINDOW) : i + 1]) and mark(words[i : i + t.WINDOW + 1])
            return around or any(t.bare(w) in t.REPORTING for w in words[max(0, i - 3) : i])

        plain, other = [h for h in hits if not in_quotes(h[0])], [h for h in hits if in_quotes(h[0])]
        weight = sum(h[2] for h in plain)
        densest = max(sum(h[2] for h in plain if i - t.WINDOW <= h[0] <= i) for i, *_ in hits)
        kinds = [np.log1p(sum(h[3] == k for h in plain)) for k in (0, 1, 2)]
        top = min(max((h[1] for h in plain), default=0), 30) / 10
        return [top, np.log1p(weight), np.log1p(densest), np.log1p(sum(h[1] >= 6 for h in plain)), *kinds, np.log1p(sum(h[2] for h in other)), weight / (10 + len(words)), np.log1p(len(words))]

    raw = np.array([features(x) for x in texts]) @ model.beta[:-1] + model.beta[-1]
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-raw)), atol=1e-9)


def test_remainders_against_sets():
    from factloom.llm.toxicity import Remainders

    def without(word, letters):
        found = {word}
        for _ in range(letters):
            found |= {w[:i] + w[i + 1 :] for w in found for i in range(len(w))}
        return found

    rng = np.random.default_rng(8)
    some = lambda n: sorted({"".join(rng.choice(list("abcé😀"), rng.integers(1, 9))) for _ in range(n)})
    for letters in (0, 1, 2):
        words, searched = some(60), some(200)
        sharing = {(i, j) for i, s in enumerate(searched) for j, w in enumerate(words) if without(s, letters) & without(w, letters)}
        assert {(i, j) for i, js in Remainders(words, letters).sharing(searched) for j in js} == sharing


def test_gam_against_loops():
    from factloom.llm.gam import fit_gam
    from factloom.llm.quality_model import FEATURES, measured

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice("alpha beta gamma 12 # | Up .\n x, yy zzzz!".split(" "), rng.integers(1, 60))).encode() for _ in range(300)]
    x = measured([b"", b" \n", *texts])
    y = (x[:, FEATURES.index("digits")] + x[:, FEATURES.index("log_words")] / 10 > 0.4).astype(float)
    model = fit_gam(x, y)
    assert model.pairs
    for row, score in zip(x, model.predict(x), strict=True):
        own = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, own, strict=True))
        total += sum(t[model.coarse[i][own[i]], model.coarse[j][own[j]]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
    # one step of boosting is the best split of the gradient into so many leaves, by trying all
    from itertools import combinations

    from factloom.llm.gam import shallow_tree

    g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
    step = shallow_tree(g, h, 2, 1.0)
    worth = lambda cuts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0) for a, b in zip((0, *cuts), (*cuts, 9), strict=True))
    best = max(combinations(range(1, 9), 1), key=worth)
    assert np.allclose(step, np.concatenate([np.full(b - a, -g[a:b].sum() / (h[a:b].sum() + 1.0)) for a, b in ((0, best[0]), (best[0], 9))]))


def test_clashing_names(spark, tmp_path):
    from factloom.llm import queries as q
    from factloom.llm.bpe_trie import bpe_decode, bpe_encode
    from factloom.llm.exact_dedup import exact_dedup
    from factloom.llm.line_dedup import line_dedup
    from factloom.llm.near_copies import keep_one
    from factloom.llm.ngram_lm import score_lm, train_lm
    from factloom.llm.packing import pack
    from factloom.llm.quality_model import fit_quality, score_quality
    from factloom.llm.quality_rules import rule_ledger
    from factloom.llm.simhash import near_dedup
    from factloom.llm.token_counts import token_counts
    from factloom.llm.toxicity import fit_toxicity, score_toxicity

    rows = [(i, t, *(f"{n}{i}" for n in CLASHING)) for i, t in ((1, "one two three"), (2, None), (None, "x y"), (1, "one two three four"), (1, "one two three"))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'`{n}` string' for n in CLASHING)}").repartition(2)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    byte, word = (q.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    kept = lambda df, taken=(): sorted((str(r["doc_id"]), *(r[n] for n in CLASHING if n.lower() not in taken)) for r in df.collect())
    all_of = lambda taken=(): sorted((str(r[0]), *(v for n, v in zip(CLASHING, r[2:], strict=True) if n.lower() not in taken)) for r in rows)
    lines = line_dedup(docs)
    assert kept(lines, ("n_lines",)) == all_of(("n_lines",)) and Counter(r["text"] for r in lines.collect()) == Counter(r[1] or "" for r in rows)
    assert kept(rule_ledger(docs), ("n_lines",)) == all_of(("n_lines",))
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        assert kept(score(docs, fit(docs, labels, F.lit(True))), ("score",)) == all_of(("score",))
    assert kept(bpe_decode(bpe_encode(docs, word), word)) == all_of()
    assert exact_dedup(docs, carry=("__id", "kept", "__th")).columns == ["doc_id", "keep_id", "group_size", "kept", "__id", "__th"]
    assert all(op.count() == len(rows) for op in (exact_dedup(docs), pack(docs, byte).where("start = 0"), near_dedup(docs), token_counts(docs, word, f"file://{tmp_path}/c"), score_lm(docs, train_lm(docs))))
    stays = keep_one(docs)
    assert stays.columns == docs.columns and kept(stays) == sorted([*{r for r in all_of() if r[0] != "1"}, *(r for r in all_of() if r[0] == "1")][: stays.count()])


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def one_of_each(rows):
    """Rows (id, text, ...) that stay: of each group of near copies the least id (none last)."""
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a == b or len(a & b) >= 0.8 * len(a | b)) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        best[g] = min((best.get(g, (True, 1 << 62)), (r[0] is None, r[0] or 0)))
    return rows, group, best


def test_keep_one_loses_nothing(spark):
    from factloom.llm.near_copies import keep_one

    words = [f"w{i}" for i in range(60)]
    rows = [
        (None, "first text without id"), (None, "second text, none either"), (None, "third one is like no other"), (1, "an id that comes"), (1, "twice with another text"),
        (5, " ".join(words)), (4, " ".join([*words[:59], "other"])), (None, " ".join(["other", *words[1:]])), (7, "the same row"), (7, "the same row"), (8, None), (9, ""), (9, "  "),
        (6, "The SAME row"),
    ]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(4)
    got = keep_one(frame).collect()
    _, group, best = one_of_each(rows)
    assert Counter(group[r["k"]] for r in got) == Counter(set(group)), "one row of each group, every group"
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == best[group[r["k"]]] for r in got)
    assert sorted((str(r["doc_id"]), r["text"]) for r in keep_one(frame).collect()) == sorted((str(r["doc_id"]), r["text"]) for r in got)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small table with what the stages look for: junk, shared lines, near copies, repeated rows, missing ids and texts."""
    rng = np.random.default_rng(11)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    shared = "This is the one line that several documents have in common"
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    for k in range(8):
        words = [word() for _ in range(80)]
        rows.append((9000 + 10 * k, " ".join(words)))
        rows.append((9001 + 10 * k, " ".join([*words[:40], "changed", *words[41:]])))
        rows.append((9002 + 10 * k, " ".join(word() for _ in range(30)) + f"\n{shared}\n" + " ".join(word() for _ in range(20))))
    rows += [(9500, None), (None, " ".join(word() for _ in range(40))), (None, " ".join(word() for _ in range(40))), rows[-1], rows[-1], (9501, "too short"), (9502, "same words " * 40)]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(len(t or "") > 150 and len(set((t or "").split())) > 10), 0) for i, t in rows if i is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_against_brute_force(spark, folder):
    import corpus_pipeline as p
    from factloom.llm.common import fixed_share
    from factloom.llm.quality_model import fit_quality, measured

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), fixed_share(F.col("doc_id"), 5) != 0)
    score = model.predict(measured([(r[1] or "").encode() for r in rows]))
    after = {"quality_classifier": [r for r, s in zip(rows, score, strict=True) if s >= 0.3]}

    def passes(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        again = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
        return not (len(words) < 10 or 100 * len(again) > 20 * len(words) or 10 * symbols > chars or 2 * (len(lines) - len(set(lines))) > text.count("\n") + 1 or chars > 30 * len(words))

    after["quality_rules"] = [r for r in after["quality_classifier"] if passes(r[1])]
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))
    holders = {}
    for r in after["quality_rules"]:
        for line in set(map(key, r[1].split("\n"))):
            holders.setdefault(line, set()).add(-1 if r[0] is None else r[0])
    gone = lambda line, i: len(line) >= 20 and len(holders[line]) >= 3 and max(holders[line]) != (-1 if i is None else i)
    cut = [(r, "\n".join(x for x in r[1].split("\n") if not gone(key(x), r[0]))) for r in after["quality_rules"]]
    after["line_dedup"] = [(r[0], t, r[2], r[3], len(t)) for r, t in cut]
    for name, stage in p.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == list(p.COLUMNS)
        assert Counter(map(tuple, docs.collect())) == Counter(after[name]), name
    assert len(rows) > len(after["quality_classifier"]) > len(after["quality_rules"]) > 30 and any(t != r[1] for r, t in cut)
    docs = p.STAGES[3][1](spark, docs, folder)
    kept = [tuple(r) for r in docs.collect()]
    everyone, group, best = one_of_each(after["line_dedup"])
    of_row = {}
    for r, g in zip(everyone, group, strict=True):
        of_row[r] = g
    assert Counter(of_row[r] for r in kept) == Counter(set(group)) and all((r[0] is None, r[0] or 0) == best[of_row[r]] for r in kept)
    assert docs.columns == list(p.COLUMNS) and len(kept) <= len(everyone) - 10
    pieces = p.run(spark, folder).collect()
    wanted = Counter(str(r[0]) for r in kept)
    assert Counter(str(r["doc_id"]) for r in pieces if r["start"] == 0) == wanted
    tokens = {}
    for r in pieces:
        tokens.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in tokens.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048


def test_pipeline_on_empty_table(spark, folder, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
