"""Ranked search, URL filters and the Merkle manifest against plain computations, and the cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash


from skein.llm import manifest, neighbours, packing, search, toxicity, url_filters

DOC = "doc_id long, text string, lang string, source string, n_chars long, item_id long, term string, n int, i int, level int, size int, path string"


def docs_of(spark, rows):
    """rows: (doc_id, text, source); other columns have the names of the operators' own."""
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 else "de", s, None if t is None else len(t), 1, "x", 2, 3, 4, 5, "p") for i, t, s in rows], DOC)


# --- ranked search ---------------------------------------------------------------------------------------------------


def plain_terms(t):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_search(docs, items, k=10):
    held = [(i, c, n) for i, t, _ in docs if (n := len(ts := plain_terms(t))) for c in [Counter(ts)]]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i, s))
        out += [(item, r, i, s) for r, (*_, i, s) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_case(seed):
    r = random.Random(seed)
    vocab = ["Solar", "grid", "é", "naïve", "x1", "THE", "the", "data", "日本"] + [f"w{k}" for k in range(30)]
    text = lambda n: " ,.".join(r.choices(vocab, k=n)) + "\n"
    docs = [(k, text(r.randint(1, 60)), "s") for k in range(80)] + [(200, None, "s"), (201, "", "s"), (202, " .!\n", "s"), (None, text(9), "s"), (5, text(20), "s"), (300, "solar " * 40_000, "s")]
    docs += [docs[3], docs[3], (301, docs[3][1], None)]
    items = [(k, text(r.randint(1, 12))) for k in range(15)] + [(90, None), (91, ""), (92, "absent"), (93, "the the THE grid"), (93, "grid"), (0, "x1"), (7, "solar"), (None, "solar grid")]
    return docs, [*items, items[2]]


@pytest.mark.parametrize("entries", [1 << 20, 60])
def test_search_is_brute_force(spark, entries):
    docs, items = search_case(4)
    got = search.ranked(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), entries=entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_search(docs, items)


def test_search_of_nothing(spark):
    none, item = docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(none, item).count() == 0
    assert search.ranked(docs_of(spark, [(1, "a", "s")]), item.limit(0)).count() == 0
    assert search.ranked(docs_of(spark, [(1, None, "s")]), item).count() == 0


def test_terms_go_part_by_part():
    text = ("Ab cé-9 " * 50).encode()
    parts = list(search.terms(text, 7))
    assert len(parts) > 20 and [t for p in parts for t in p] == [t.encode() for t in plain_terms(text.decode())]


# --- URL filters -----------------------------------------------------------------------------------------------------


def plain_parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path, rules):
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_shape(path):
    every = path.removeprefix("/").split("/")
    if len(every) > url_filters.DEPTH:
        every = [*every[: url_filters.DEPTH - 1], "/".join(every[url_filters.DEPTH - 1 :])]
    out = []
    for s in every:
        end = m[1] if (m := re.search(r"(\.[A-Za-z0-9]{1,5})$", s)) else ""
        stem = s[: len(s) - len(end)]
        kind = "<n>" if re.fullmatch("[0-9]+", stem) else "<x>" if re.fullmatch("[0-9a-fA-F-]{8,}", stem) else "<id>" if len(stem) >= 12 and re.search("[0-9]", stem) else None
        out.append(s if kind is None else kind + end)
    return tuple(out)


def plain_tree(shapes):
    """shapes: (host, shape) to [n, labelled, blocked]; gives the template of each."""
    node = dict.fromkeys(shapes, "")
    for d in range(url_filters.DEPTH):
        of = defaultdict(lambda: defaultdict(list))
        for (host, shape), counts in shapes.items():
            if len(shape) > d:
                rest = "/".join(s if s.startswith("<") else "w" for s in shape[d + 1 :])
                h = xxhash.xxh64_intdigest(rest.encode(), 42)
                of[host, node[host, shape]][shape[d]].append(((h - 2**64 if h >= 2**63 else h) % url_filters.BINS, counts, (host, shape)))
        for (_host, at), children in of.items():
            size = {c: sum(x[1][0] for x in xs) for c, xs in children.items()}
            whole = sum(size.values())
            kept = {c: "*" if len(children) > url_filters.FEW and size[c] < url_filters.RARE * whole else c for c in children}
            pool = {}
            for c, xs in children.items():
                p = pool.setdefault(kept[c], [0, 0, 0, [0] * url_filters.BINS])
                for b, (n, lab, blk), _ in xs:
                    p[0], p[1], p[2] = p[0] + n, p[1] + lab, p[2] + blk
                    p[3][b] += n
            branches = []
            for name, p in sorted(pool.items(), key=lambda x: (-x[1][0], x[0])):
                for b in branches:
                    apart = sum(abs(x / b[1][0] - y / p[0]) for x, y in zip(b[1][3], p[3], strict=True)) / 2
                    rate = (b[1][2] + p[2]) / max(b[1][1] + p[1], 1)
                    error = math.sqrt(rate * (1 - rate) * (1 / max(b[1][1], 1) + 1 / max(p[1], 1)))
                    apart_rate = abs(b[1][2] / max(b[1][1], 1) - p[2] / max(p[1], 1))
                    if apart <= url_filters.NEAR + math.sqrt(1 / b[1][0] + 1 / p[0]) and (not b[1][1] or not p[1] or apart_rate <= url_filters.ERRORS * error):
                        b[0].append(name)
                        b[1] = [b[1][0] + p[0], b[1][1] + p[1], b[1][2] + p[2], [x + y for x, y in zip(b[1][3], p[3], strict=True)]]
                        break
                else:
                    branches.append([[name], p])
            to = {m: "|".join(sorted(b[0])) for b in branches for m in b[0]}
            for c, xs in children.items():
                for *_, key in xs:
                    node[key] = at + "/" + to[kept[c]]
    return node


def plain_verdicts(pages, rules, labels=None):
    seen = [(i, *plain_parse(u)) for i, u in pages]
    said = [plain_rule(h, p, rules) for _, h, p in seen]
    known = [v for _, v in said] if labels is None else [labels.get(i) for i, *_ in seen]
    shapes = defaultdict(lambda: [0, 0, 0])
    for (_, h, p), k in zip(seen, known, strict=True):
        c = shapes[h, plain_shape(p)]
        c[0], c[1], c[2] = c[0] + 1, c[1] + (k is not None), c[2] + (k == "block")
    node = plain_tree(shapes)
    tree, hosts, whole = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0]), [0, 0, 0]
    for key, c in shapes.items():
        for total in (tree[key[0], node[key]], hosts[key[0]], whole):
            for k in range(3):
                total[k] += c[k]
    rate = lambda c, prior: (c[2] + url_filters.PRIOR * prior) / (c[1] + url_filters.UNKNOWN * (c[0] - c[1]) + url_filters.PRIOR)
    every = rate(whole, 0.5)
    bad = {t for t, c in tree.items() if rate(c, rate(hosts[t[0]], every)) >= url_filters.PURE and c[2] >= url_filters.LEAST_BLOCKED}
    return sorted(((i, h, p, r, v or ("block" if (h, node[h, plain_shape(p)]) in bad else "allow")) for (i, h, p), (r, v) in zip(seen, said, strict=True)), key=str)


def made_pages(seed):
    r = random.Random(seed)
    hosts = ["a.example.com", "m.b.example.org", "www.c.example.net", "shop.other.io", "d.example.com"]
    pages = []
    for k in range(700):
        h = r.choice(hosts)
        kind = r.choice(["de", "de", "en", "fr"]) if not h.startswith("d.") else r.choice(["de"] * 40 + ["xx"])
        tail = r.choice([str(r.randint(1, 9999)), f"{r.randint(1, 99)}.html", "-".join(r.choices(["red", "blue", "solar", "tree"], k=3)), f"item/{r.randint(1, 9)}/view", f"post-{r.randint(10**9, 10**10)}-x", "deadbeef99"])
        pages.append((k, f"https://{h}/{kind}/{tail}{r.choice(['', '?q=1', '#top'])}"))
    pages += [(k, f"http://shop.other.io/t{k}/x") for k in range(700, 760)] + [(800, None), (801, ""), (802, "no scheme"), (803, "HTTP://X.NET"), (804, "a://b://c/d"), (None, "http://Example.NET/en/Ab?x"), (805, "http://net/x\ny"), (806, "http://org/fr/" + "a/" * 3000), (807, "://?")]
    return [*pages, pages[0], pages[0]]


def page_frame(spark, pages):
    return spark.createDataFrame([(i, u, "h", "b", 1, "c", "w") for i, u in pages], "page_id long, url string, host string, branch string, n int, shape string, label string")


@pytest.mark.parametrize("given", [False, True])
def test_url_verdicts_are_those_of_a_plain_tree(spark, given):
    pages = made_pages(2)
    r = random.Random(9)
    labels = {i: "block" if "/de/" in u or r.random() < 0.1 else "allow" for i, u in pages[:600] if r.random() < 0.9} if given else None
    frame = None if labels is None else spark.createDataFrame([*labels.items(), (3, None), (9999, "block")], "page_id long, label string")
    got = url_filters.judge(page_frame(spark, pages), labels=frame)
    want = plain_verdicts(pages, url_filters.RULES, labels)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    free = Counter(v for *_, r_, v in want if r_ is None)
    assert free["block"] and free["allow"]  # the tree rejects templates that no rule names, and not all


def test_url_rules(spark):
    urls = ["http://net/", "http://net", "http://a.NET/x", "http://xnet/", "http://example.net/en/1", "http://a.example.net/en", "http://b.example.com/de/1", "http://example.com/DE/1", "http://org/fr/", "http://net:80/"]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filters.judge(page_frame(spark, list(enumerate(urls)))).collect()}
    assert [got[k][1] for k in range(10)] == ["net/", None, "net/", None, "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None]
    assert (got[0][2], got[4][2], got[6][2], got[8][2], got[2][0]) == ("block", "allow", "block", "allow", "a.net")
    assert url_filters.judge(page_frame(spark, [])).count() == 0


# --- Merkle manifest -------------------------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(i, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    for row in levels[:-1]:
        run = i - i % 3
        yield i % 3, [d for k, d in enumerate(row[run : run + 3], run) if k != i]
        i //= 3


def plain_manifest(rows):
    by = defaultdict(list)
    for i, source, lang, n, text in rows:
        leaf = plain_leaf(i, source, lang, n, text)
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        by[source].append((i is not None, i or 0, leaf, i, plain_leaf(i, source, lang, n, text.replace("\n", "")) if even and text else leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree_of([x[2] for x in sorted(by[s])]) for s in order}
    top = plain_tree_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, leaf, i, now) in enumerate(sorted(by[s])):
            path = [*plain_path(trees[s], at), *plain_path(top, k)]
            for place, siblings in path:
                now = sha("".join([*siblings[:place], now, *siblings[place:]]))
            root = top[-1][0]
            out.append((i, leaf, trees[s][-1][0], root, sha("".join(x for _, ss in path for x in ss)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "n_sources", "unit"), [(1, 1, 6), (4, 4, 6), (700, 3, 2), (300, 30, 1)])
def test_manifest_is_a_plain_tree(spark, n, n_sources, unit):
    r = random.Random(n)
    rows = []
    for k in range(n):
        source = None if k % 11 == 5 else f"s{'é' * (k % 2)}{int(n_sources * r.random() ** 3)}"
        text = r.choice([None, "", "one line", "two\nlines", "a\n\nb\n", "é\n" * 5])
        rows.append((None if k % 50 == 7 else r.choice([k, k, k // 2, -k]), source, None if k % 3 else "de", None if text is None else len(text), text))
    rows += rows[:2]
    made = spark.createDataFrame([(*x, "x", 1, 2, 3, "p") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, size int, i int, level int, path string").repartition(5)
    got = sorted((tuple(x) for x in manifest.manifest(made, unit).collect()), key=str)
    assert got == plain_manifest(rows)
    if n == 700:
        assert {x[-1] for x in got} == {True, False}


def test_manifest_of_nothing_and_of_lone_leaves(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    one = manifest.manifest(spark.createDataFrame([(7, "s", "en", 1, "a")], schema)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == plain_leaf(7, "s", "en", 1, "a") and one.proof_sha256 == sha("") and one.verified


def test_parents_wait_for_their_arity():
    p = manifest.Parents()
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    for k in (4, 0, 2):
        p.arrive(b"t", 5, 0, k, leaves[k])
    assert not p.done and len(p.frontier()) == 3
    p.arrive(b"t", 5, 0, 3, leaves[3])
    p.arrive(b"t", 5, 0, 1, leaves[1])
    assert p.done[-1][4].hex() == plain_tree_of([x.hex() for x in leaves])[-1][0] and not p.frontier()


# --- earlier operators: what their verdicts asked for ----------------------------------------------------------------


def test_misspelled_abuse_counts_and_quotation_does_not(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abdegilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(400)]

    def text(*extra):
        return " ".join([*r.choices(vocab, k=30), *extra, *r.choices(vocab, k=30)])

    for n in (150, 400):
        texts = [text() for _ in range(n)] + [text("you", "are", r.choice(["worthless", "pathetic", "disgusting"]) + "!") for _ in range(150)]
        more = [text("you", "are", "wortless!"), text("he", "said", '"worthless"', "wrote", "a", "word"), text("you", "are", "worthless!"), text()]
        docs = docs_of(spark, [(i, t, "s") for i, t in enumerate([*texts, *more])])
        labels = spark.createDataFrame([(i, int(i >= n)) for i in range(n + 150)], "doc_id long, toxic int")
        got = {x.doc_id: x.score for x in toxicity.classify(docs, labels).collect()}
        wrong, told, abuse, clean = (got[n + 150 + i] for i in range(4))
        assert abuse > wrong > 0.5 > max(clean, told)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_toxicity_scores_are_those_of_a_plain_reading(spark):
    lexicon = toxicity.Lexicon(["badword", "awful", "vil"], ["stupid"], [2.0, 1.0, 3.0, 1.5], [True, True, False, True])
    model = toxicity.Model(lexicon, np.array([1.5, 0.8, -1.0, 0.5, 0.3]), -1.0)
    r = random.Random(5)
    pool = ["badword", "badwrd", "Badword!", '"awful"', "awfull", "vil", "vill", "stupidity", "stpidity", "said", "you", "your!", "plain", "words", "here", "zitat", "«x»", "STUPID", "x" * 70]
    texts = [" ".join(r.choices(pool, k=r.randint(1, 40))) for _ in range(60)] + [None, "", "badword"]

    def find(word):
        b = word.lower().strip(toxicity.EDGE.decode())
        if len(b) > 64:
            return None
        if any(b.startswith(s) for s in lexicon.stems):
            return (1, 3)  # a stem that has been read decides
        exact = [k for k, e in enumerate(lexicon.whole) if b == e]
        if exact:
            return (1, exact[0])
        near = [(0, k) for k, e in enumerate(lexicon.whole) if lexicon.near[k] and edits(b, e) == 1] + [(1, 3) for n in range(len(b) + 1) if edits(b[:n], "stupid") == 1]
        return (0, min(near)[1]) if near else None

    def plain(text):
        ws = (text or "").split()
        finds = [(i, f) for i, w in enumerate(ws) if (f := find(w))]
        if not finds:
            return 1 / (1 + math.exp(1.0))
        sums, told, meant, best = [0.0, 0.0], 0.0, 0.0, {}
        for i, (exact, k) in finds:
            speak = [0.0, 0.0]
            for j in range(max(0, i - 4), min(len(ws), i + 5)):
                near, b = 1 / (1 + abs(j - i)), ws[j].lower().strip(toxicity.EDGE.decode()).encode()
                speak[0] += near * ((b in toxicity.REPORT) + any(q.decode() in ws[j] for q in toxicity.QUOTES))
                speak[1] += near * ((b in toxicity.ADDRESS) + ("!" in ws[j]))
            share = 1 / (1 + math.exp(speak[0] - speak[1] - 1))
            sums[exact] += lexicon.strength[k] * share
            told += lexicon.strength[k] * (1 - share)
            meant += share
            best[k] = max(share, best.get(k, 0))
        x = [math.log1p(sums[1]), math.log1p(sums[0]), math.log1p(told), min(1, 100 * meant / len(ws)), math.log1p(sum(best.values()))]
        return 1 / (1 + math.exp(-(-1.0 + float(np.dot(x, model.weights)))))

    got = {r_.doc_id: r_.score for r_ in toxicity.score(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()}
    assert all(math.isclose(got[i], plain(t), rel_tol=1e-9) for i, t in enumerate(texts))


def test_neighbours_keep_doubles_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], "q", 1), (2, [0.1, 1.0], "q", 1), (3, [1e39, 1.0], "q", 1), (20, [1.0, 0.0], "q", 1), (20, [0.0, 1.0], "q", 1), (20, [0.0, 1.0], "q", 1), (4, [float("inf"), 1.0], "q", 1), (None, [1.0, 1.0], "q", 1)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, rank int"))
    # both vectors of 20 ask; a candidate is as near as it is to the nearer
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(20, 1, 3, 1e39), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]


def test_packing_of_nothing_and_of_nasty_rows(spark):
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    assert packing.pack_documents(docs_of(spark, []), path).count() == 0
    docs = docs_of(spark, [(None, None, "s"), (None, "no id", None), (1, "a b", "s"), (1, "a b", "s"), (1, "other", "s"), (2, "word " * 5000, "s"), (3, "", "s")])
    got = packing.pack_documents(docs, path).collect()
    assert sum(r.piece == 0 for r in got) == 7 and max(r.length for r in got) <= 2048
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_text_of_more_words_than_the_table_holds():
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    small, large = packing.Ids(path, 50), packing.Ids(path)
    text = " ".join(f"word{k} plain" for k in range(300)).encode()
    for t in (b"plain word1 other", text, b"plain word1 word299", text + b" more"):
        assert small.of(t) == large.of(t)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_all_queries_are_registered():
    from skein.llm.queries import ORACLE_SQL, QUERIES

    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))
    assert {"op11_ranked_search", "op13_merkle_manifest"} <= set(ORACLE_SQL)
