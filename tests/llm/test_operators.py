"""Each corpus operator against a plain computation, and the cases its docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from skein.llm import classifier, language_model, lines, mixing, neighbours, packing, quality_rules, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m long, fp long, h long, g int, key string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"src{i % 3}", None, 1, 2, 3, 4, "k") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def made_texts(n=60, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(150)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    out = [None, "", " \n\t ", "one", "word " * 3000]
    for _ in range(n):
        ws = [r.choice(vocab) for _ in range(r.randint(1, 90))]
        t = re.sub(r"z$", "", " ".join(ws))
        if r.random() < 0.4:
            t += " " + passage + " " + r.choice(vocab)
        if r.random() < 0.3 and out[-1]:
            t = out[-1] if r.random() < 0.5 else out[-1] + " x"
        out.append(t.replace(" ", "\n", 1))
    return out


@pytest.fixture(scope="module")
def texts():
    return made_texts()


def words(t):
    return (t or "").encode().split()


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language_model.score_documents(docs).count() == 0
    assert quality_rules.judge(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert classifier.classify(docs, labels).count() == 0
    assert toxicity.classify(docs, labels).count() == 0
    assert lines.without_repeated_lines(docs).count() == 0
    assert mixing.mix_sources(docs).count() == 0
    assert substrings.remove_repeats(docs).count() == 0


def test_language_model(spark, texts):
    got = {r.doc_id: r for r in language_model.score_documents(frame(spark, texts)).collect()}
    c = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    for i, t in enumerate(texts):
        if not held[i]:
            c.update([*(w.lower() for w in words(t)), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        ws = [*(w.lower() for w in words(t)), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
    assert len(got) == len(texts) and all(r.score <= 0 for r in got.values())


class PlainAutomaton:
    """States, arcs and failure arcs as dictionaries, from counts by length."""

    def __init__(self, counts, mu):
        self.c, self.mu = counts, mu
        self.n, self.v = sum(counts[0].values()), len(counts[0])

    def p(self, history, w):
        if not history:
            return (self.c[0][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        total, mu = self.c[len(history) - 1][history], self.mu[len(history) - 1]
        return (self.c[len(history)][(*history, w)] + mu * self.p(history[1:], w)) / (total + mu)

    def score(self, ws):
        state, out = (), 0.0
        for w in ws:
            while state and not self.c[len(state)][(*state, w)]:
                mu = self.mu[len(state) - 1]
                out += math.log10(mu / (self.c[len(state) - 1][state] + mu))
                state = state[1:]
            out += math.log10(self.p(state, w))
            state = (*state, w)[-2:] if state else (w,) if self.c[0][(w,)] else ()
        return out


def training_counts(rows):
    c = [Counter(), Counter(), Counter()]
    for i, ws in enumerate(rows):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for d in range(3):
                c[d].update(zip(*(ws[k:] for k in range(d + 1))))
    return c


@pytest.mark.parametrize("group_chars", [20_000_000, 6_000])
def test_language_model_is_a_backoff_automaton(spark, texts, group_chars):
    texts = [*texts, "word " * 60000, "rare follow here", "rare follow there", "rare follow here", "word " * 9000 + "rare follow there"]
    got = {r.doc_id: r.score for r in language_model.score_documents(frame(spark, texts), group_chars).collect()}
    rows = [[*(w.lower() for w in words(t)), None] for t in texts]
    c = training_counts(rows)

    def table(counts, end=True):
        kinds = Counter(int(language_model.buckets(np.array([n]))[0]) for k, n in counts.items() if end or k != (None,))
        sums = Counter()
        for k, n in counts.items():
            if end or k != (None,):
                sums[int(language_model.buckets(np.array([n]))[0])] += n
        return {b: (kinds[b], sums[b]) for b in kinds}

    tables = [table(c[0], False), table(c[1]), table(c[2])]
    model = PlainAutomaton(c, (language_model.prior(tables[0], tables[1]), language_model.prior(tables[1], tables[2])))
    for i, ws in enumerate(rows):
        assert math.isclose(got[i], model.score(ws), rel_tol=1e-9, abs_tol=1e-9)
    seen = [w for (w,) in c[0]]
    for history in ((), ("rare",), ("rare", "follow"), (next(w for w in seen if w),)):
        if not history or c[len(history) - 1][history]:
            assert math.isclose(sum(model.p(history, w) for w in seen) + model.p(history, "never seen"), 1.0)


def test_language_model_prefers_what_it_has_read(spark, texts):
    got = language_model.score_documents(frame(spark, texts)).where("not held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_quality_rules(spark, texts):
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = words(t)
        c = Counter(zip(ws, ws[1:], ws[2:]))
        hit = {j + d for j, w in enumerate(zip(ws, ws[1:], ws[2:])) if c[w] > 1 for d in range(3)}
        seen, dup = set(), 0
        for x in (t or "").encode().split(b"\n"):
            if x.split():
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(len(w.decode()) for w in ws), sum(w.count(x) for w in ws for x in b"#*$%&|<>"), dup, len(hit))
        assert r.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws)) and not (r.kept and r.base_failed)


def test_quality_fences_follow_their_group(spark):
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(5000)]

    def text(bangs):
        ws = r.sample(vocab, 100)
        return " ".join(w + "!" if i < bangs else w for i, w in enumerate(ws))

    rows = [(i, text(0), "en", "calm", 1) for i in range(60)] + [(100 + i, text(r.randint(0, 30)), "en", "loud", 1) for i in range(60)]
    rows += [(1, text(5), "en", "calm", 1), (101, text(25), "en", "loud", 1)]
    got = {(x.doc_id, x.source, x.bang_ratio): x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[1, "calm", 0.05].kept and got[101, "loud", 0.25].kept


def fingerprint(t):
    ws = (t or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(fps))}


@pytest.mark.parametrize("n", [3, 300, 5000])
def test_forest_joins_what_is_close(n):
    r = np.random.default_rng(n)
    centres = r.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(centres[r.integers(0, 4, n)] ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)))
    edges = simhash.forest(fps, 4)
    assert all(int(fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    assert len(edges) == len(fps) - len({find(i) for i in range(len(fps))})
    assert len({find(i) for i in range(len(fps))}) <= 4


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[200:260] = x[200]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(600)] + [(700, None, 0), (720, [0.0] * 16, 0), (740, [float("nan")] * 16, 0), (760, [1.0], 0)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), k=5, degree=12, block=100).collect()
    s = x.astype(float) @ x.astype(float).T
    hit = total = 0
    for q in range(0, 600, 20):
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in own] == [1, 2, 3, 4, 5]
        assert all(math.isclose(g.score, s[q, g.vec_id], rel_tol=1e-9, abs_tol=1e-9) and g.vec_id != q for g in own)
        want = sorted((j for j in range(600) if j != q), key=lambda j: (-round(s[q, j], 12), j))[:5]
        hit += len({g.vec_id for g in own} & set(want))
        total += 5
    assert hit >= 0.9 * total and {g.query_id for g in got} == set(range(0, 600, 20))


def test_neighbours_in_divided_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_PIVOTS", 5)
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 8)).astype(np.float32)
    got = neighbours.nearest(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "vec_id long, embedding array<float>"), k=5, degree=12, block=10).collect()
    s = x.astype(float) @ x.astype(float).T
    hit = 0
    for q in range(0, 600, 20):
        want = sorted((j for j in range(600) if j != q), key=lambda j: (-round(s[q, j], 12), j))[:5]
        hit += len({g.vec_id for g in got if g.query_id == q} & set(want))
    assert hit >= 0.9 * 5 * 30


def test_rows_that_meet_are_in_proportion_to_the_vectors(spark, monkeypatch):
    r = np.random.default_rng(5)
    met, plain = [], neighbours.met_at
    monkeypatch.setattr(neighbours, "met_at", lambda rows: (met.append(rows.count()), plain(rows))[1])
    for n in (200, 1000):
        x = r.normal(size=(n, 8))
        x[0] *= 50  # near to very many
        table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "vec_id long, embedding array<float>")
        assert neighbours.nearest(table, k=5, degree=12, block=50, width=4).count() == n // 20 * 5
        assert met and max(met) <= 3 * 4 * n
        met.clear()


def test_what_meets_at_a_node(spark):
    rows = [(1, 10, True, -math.inf, [1.0, 0.0]), (1, 11, False, 0.5, [1.0, 1.0]), (1, 12, False, -math.inf, [0.0, 1.0]), (2, 10, False, -math.inf, [1.0, 0.0]), (2, 12, True, 0.5, [0.0, 1.0])]
    got = neighbours.met_at(spark.createDataFrame(rows, "via long, c long, fresh boolean, least double, v array<float>")).collect()
    # 11 and 12 are old to each other; 12 takes nothing below 0.5 at node 2
    assert sorted((g.node, sorted(zip(g.near, g.sims, strict=True))) for g in got) == [(10, [(11, 1.0), (12, 0.0)]), (10, [(12, 0.0)]), (11, [(10, 1.0)]), (12, [(10, 0.0)])]


def test_classifiers(spark):
    good = ["the house by the river was old and quiet in the evening " * 6 + f"number {i}" for i in range(60)]
    bad = [f"buy$$$ now%%% cheap*** {i} " * 20 for i in range(60)]
    vile = [t + " you idiot scumbag" for t in good]
    docs = frame(spark, [*good, *bad, *vile, None])
    labels = spark.createDataFrame([(i, int(not 60 <= i < 120), int(120 <= i < 180)) for i in range(180)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in classifier.classify(docs, labels).collect()}
    assert len(q) == 181 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in q.items())
    assert all(q[i].predicted == (not 60 <= i < 120) for i in range(180))
    t = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in t.items())
    assert all(t[i].predicted == (120 <= i < 180) for i in range(180))
    none = labels.where("doc_id < 0")
    assert {r.score for r in classifier.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5}


def test_automaton_is_within_one_edit():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j - 1] + (x != y), d[j] + 1, e[-1] + 1))
            d = e
        return d[-1]

    r = random.Random(1)
    whole = ["idiot", "moron", "scums", "abcab", "abc"]
    a = toxicity.Automaton(whole, ["lowe"])
    for _ in range(4000):
        w = list(r.choice(whole))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "o", "x"])
        w = "".join(w)
        near = 1 if w in whole else 3 if any(len(e) >= 5 and distance(w, e) <= 1 for e in whole) else 0
        assert a.find(w)[0] == near, w
    assert a.find("lowering") == (2, 5) and a.find("lowing")[0] == 0
    b = toxicity.Automaton(["vile"], ["worthl", "scum"])
    for w, what in (("worthless", 2), ("wortless", 4), ("worxhlessly", 4), ("worthxless", 4), ("wrothless", 0), ("scxm", 0), ("vilx", 0), ("worth", 0 if distance("worth", "worthl") > 1 else 4)):
        assert b.find(w)[0] == what, w


def test_quotation_is_told_from_abuse_and_misspelled_abuse_counts(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abdegilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(400)]

    def text(*extra):
        return " ".join([*r.choices(vocab, k=30), *extra, *r.choices(vocab, k=30)])

    texts = [text() for _ in range(400)] + [text("you", "are", r.choice(["worthless", "pathetic", "disgusting"]) + "!") for _ in range(150)]
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(550)], "doc_id long, toxic int")
    more = [text("you", "are", "wortless!"), text("he", "said", "\"worthless\"", "wrote", "a", "word"), text("you", "are", "worthless!"), text()]
    docs = frame(spark, [*texts, *more])
    model = toxicity.train(docs, labels)
    w = dict(zip(toxicity.COLUMNS, model.weights.tolist()))
    assert w["abuse"] > 0 and w["misspelled"] > 0 and w["quoted"] < w["abuse"]
    lexicon = toxicity.Lexicon(["worthless"], [], [3.0], [True])
    x = np.array([toxicity.measures(t.encode(), toxicity.finder(lexicon)) for t in more])
    wrong, told, abuse, clean = toxicity.Model(lexicon, toxicity.PRIOR, -2.0).scores(x)
    assert abuse > wrong > clean and abuse > told > clean


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank in the quiet evening light of may today"
    other = "completely different words are found in this line of text about mountains and their snow in the winter months ahead"
    texts = [base + "\n" + other, "Intro\n" + base.upper() + "!", other.replace("snow", "ice") + "\n\nlast", None, "", base, "Intro"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.without_repeated_lines(frame(spark, texts)).collect()}
    assert got[0] == (texts[0], 2, 0)
    assert got[1] == ("Intro", 2, 1)
    assert got[3][0] is None and got[4][0] == "" and got[5] == ("", 1, 1) and got[6] == ("", 1, 1)


@pytest.mark.parametrize("shortest, longest", [(5, 15), (16, 30), (31, 120)])
def test_lines_find_what_brute_force_finds(spark, shortest, longest):
    r = random.Random(longest)
    vocab = [f"w{i}" for i in range(400)]
    made = []
    for _ in range(60):
        ws = r.choices(vocab, k=r.randint(shortest, longest))
        made.append(list(ws))
        for _ in range(r.choice([0, 1, 2, len(ws) // 5, len(ws) // 5 + 1])):  # up to the bound, and beyond it
            at = r.randrange(len(ws))
            ws[at : at + r.choice([0, 1, 1])] = r.choices(vocab, k=r.choice([0, 1, 1]))
        made.append(ws)
    root = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if min(len(made[i]), len(made[j])) >= 5 and lines.edits(made[i], made[j]) <= max(len(made[i]), len(made[j])) // 5 or made[i] == made[j]:
                root = [root[j] if x == root[i] else x for x in root]
    want = {i for i in range(len(made)) if i != root.index(root[i])}
    got = {x.doc_id for x in lines.repeated_lines(frame(spark, [" ".join(ws) for ws in made])).collect()}
    assert got == want and len(want) > 20


def test_packing_leaves_no_table_of_words_in_a_worker(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    from skein.llm.queries import TOKENIZER

    path = public_tokenizers.path(TOKENIZER)
    cut = packing.pieces(frame(spark, [f"plain words {i}" for i in range(50)]).coalesce(1), path)
    assert cut.count() == 50
    left = spark.range(8, numPartitions=8).mapInArrow(lambda it: (b.append_column("left", [len(packing.coder(path))] * b.num_rows) for b in it), "id long, left long")
    assert left.agg(F.max("left")).first()[0] == 0


def test_edits_are_levenshtein():
    r = random.Random(2)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j - 1] + (x != y), d[j] + 1, e[-1] + 1))
            d = e
        assert lines.edits(a, b) == d[-1]


def test_mixing_matches_sql(spark, texts, tmp_path):
    import duckdb

    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(mixing.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.mix_sources(docs).toPandas()[want.columns.tolist()].sort_values("doc_id").reset_index(drop=True)
    assert (got.fillna("?").values == want.fillna("?").values).all()
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    extra = ["it's <|endoftext|> <|ENDOFTEXT|> don't\x01!! Ünï-cödé   é a,,b ?! \x1c İK", "x" * 5000]
    got = packing.pack_documents(frame(spark, [*texts, *extra]), path).collect()
    by_doc: dict[int, list] = {}
    by_seq: dict[int, list] = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate([*texts, *extra]):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = ids[2048 * k : 2048 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert sum(r.length for r in by_doc[i]) == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in got) // 2048) + 1


def test_substrings(spark, texts):
    got = {r.doc_id: r for r in substrings.digest(substrings.remove_repeats(frame(spark, texts))).collect()}
    first: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        ws = words(t)
        gone = set()
        for j in range(len(ws) - 12):
            if first.setdefault(tuple(ws[j : j + 13]), i) < i:
                gone |= set(range(j, j + 13))
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept).hexdigest())


def nasty(spark):
    """Null ids, repeated rows and ids, ties, a long text, and columns whose names the operators use themselves."""
    line = "a line of some length that two documents have in common with one another"
    long = "\n".join(f"line {i} of a very long text with number {i * i} in it" for i in range(3_000))
    rows = [(1, line + "\nown words here", "en"), (1, line + "\nown words here", "en"), (1, "another text of the same id\n" + line, None), (None, line, "en"), (None, "no id at all", None), (None, None, None), (2, long, "de"), (3, long + "\nmore", "de"), (4, None, None), (5, "", "")]
    names = "slot line h th root n_lines n_removed kept gone fp node key g r c n count w s l"
    rows = [(i, t, x, f"s{x}", *[7] * len(names.split())) for i, t, x in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in names.split())), rows


def test_nasty_rows(spark):
    docs, rows = nasty(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    n = len(rows)
    assert language_model.score_documents(docs).count() == n
    assert quality_rules.judge(docs).count() == n
    assert {c for r in simhash.near_duplicates(docs).where("doc_id = 1").collect() for c in [r.component_id]} == {1}
    assert classifier.classify(docs, labels).count() == n and toxicity.classify(docs, labels).count() == n
    assert mixing.mix_sources(docs).count() == n
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert got[None, 14] == 0 and got[3, 36_001] == 36_000
    kept = sorted((str(r.doc_id), r.text or "", r.n_lines, r.n_removed) for r in lines.without_repeated_lines(docs).collect() if r.doc_id not in (2, 3))
    common, other = rows[0][1].split("\n")[0], "another text of the same id"
    assert len(kept) == 8 and ("None", "", 0, 0) in kept and ("None", "no id at all", 1, 0) in kept
    twins = [(t, k, m) for i, t, k, m in kept if i == "1"]
    assert sorted(t for t, _, _ in twins) in (sorted([rows[0][1]] * 2 + [other]), sorted(["own words here"] * 2 + [rows[2][1]]))  # one of the two texts keeps it
    assert set(lines.rewritten(docs).columns) == {*docs.columns, "__lines"}
    assert simhash.one_of_each(docs).columns == docs.columns and quality_rules.kept_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_large_components_are_verified_word_by_word(spark):
    r = random.Random(3)
    base = r.choices([f"w{i}" for i in range(300)], k=40)
    made = []
    for _ in range(60):
        ws = list(base)
        for _ in range(r.randint(0, 3)):
            ws[r.randrange(40)] = f"w{r.randrange(300)}"
        made.append(" ".join(ws))
    docs = frame(spark, made)
    want = {tuple(x) for x in lines.repeated_lines(docs).select("doc_id", "line").collect()}
    assert {tuple(x) for x in lines.repeated_lines(docs, most=5).select("doc_id", "line").collect()} == want and len(want) > 50


@pytest.mark.parametrize("name", ["op2_quality_rules", "op10_substring_dedup"])
def test_queries_match_sql(spark, texts, tmp_path, name):
    import duckdb

    from skein.llm import queries

    frame(spark, [*texts, *texts[-3:]]).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()[want.columns.tolist()]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))


def test_longer_repeats(spark):
    a = [f"w{i}" for i in range(60)]
    docs = frame(spark, [" ".join(a), "x " + " ".join(a[:55]), "y z"])
    got = {(r.doc_id, r.start): r.words for r in substrings.longer_repeats(docs).collect()}
    assert got[0, 0] == 52 and got[1, 1] == 52 and (2, 0) not in got


def test_repeated_rows_do_not_crash(spark, texts):
    docs = frame(spark, texts[:20]).union(frame(spark, texts[:20]))
    assert simhash.near_duplicates(docs).count() == 40
    assert substrings.remove_repeats(docs).count() == 40
    assert lines.without_repeated_lines(docs).count() == 40
    assert mixing.mix_sources(docs).count() == 40
    assert language_model.score_documents(docs).count() == 40


def test_a_text_is_split_once(spark):
    again = "the same line of five words"
    docs = frame(spark, [f"a\n{again}\n\nb", f"x\n{again}\n\ny\n{again}"])
    out = lines.rewritten(docs)
    # not once a line that stays
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert sorted(r.text for r in out.collect()) == [f"a\n{again}\n\nb", "x\n\ny"]
