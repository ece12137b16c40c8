import random
from collections import Counter, defaultdict

import duckdb
import pytest
from cases import awkward, docs, empty, words
from pyspark.sql import functions as F

from citeloom.llm import mixing, rollup, url_trust
from citeloom.llm.common import pick, scratch

FEED = "kind string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"


def totals(store):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_rollup_of_random_feeds(spark):
    rng = random.Random(1)
    path, held, batches = scratch(spark, "rollup"), {}, []
    for b in range(5):
        rows = []
        for _ in range(40):
            d = rng.randrange(30)
            if d in held and rng.random() < 0.4:
                s, n = held.pop(d)
                rows.append(("delete", d, s, "en", "v1", n, None))
            elif d in held:
                s, n = held[d]
                new = rng.randrange(100)
                rows.append(("revise", d, s, "en", "v1", new, n))
                held[d] = (s, new)
            else:
                held[d] = (rng.choice(["a", None]), rng.randrange(100))
                rows.append(("insert", d, held[d][0], "en", "v1", held[d][1], None))
        batches.append((f"b{b}", spark.createDataFrame(rows, FEED)))
    store = rollup.TokenRollup(spark, path)
    assert totals(store) == {}
    order = batches + batches[:3]  # three arrive twice
    for k, (name, df) in enumerate(order):
        assert store.commit(name, df) == (k < 5)
        if k == 2:
            store.compact()
    expected = defaultdict(lambda: [0, 0])
    for s, n in held.values():
        expected[s, "en", "v1"][0] += 1
        expected[s, "en", "v1"][1] += n
    assert totals(store) == {k: tuple(v) for k, v in expected.items()}
    store.compact()
    assert totals(rollup.TokenRollup(spark, path)) == {k: tuple(v) for k, v in expected.items()}


def test_rollup_rejects_bad_input(spark):
    store = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    with pytest.raises(ValueError):
        store.commit("../x", spark.createDataFrame([], FEED))
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("x", spark.createDataFrame([("move", 1, "a", "en", "v", 1, 1)], FEED))
    assert totals(store) == {}
    assert store.commit("x", spark.createDataFrame([("insert", 1, "a", None, "v", None, None)], FEED)) and totals(store) == {("a", None, "v"): (1, 0)}


def insert(spark, n, *, source="a"):
    return spark.createDataFrame([("insert", 1, source, "en", "v", n, None)], FEED)


def test_two_writers_of_one_batch(spark, monkeypatch):
    path = scratch(spark, "rollup")
    one, two = rollup.TokenRollup(spark, path), rollup.TokenRollup(spark, path)
    true = two._sum

    def late(changes):  # the first writer commits when the second is past its look for the marker
        assert one.commit("b", insert(spark, 1))
        return true(changes)

    monkeypatch.setattr(two, "_sum", late)
    assert two.commit("b", insert(spark, 1)) is False
    assert totals(one) == {("a", "en", "v"): (1, 1)} and one.committed() == ["b"]
    assert len(one._names("data")) == 1  # the loser's folder is gone


def test_many_writers_of_one_batch(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = scratch(spark, "rollup")
    stores = [rollup.TokenRollup(spark, path) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: stores[k].commit("b", insert(spark, k + 1)), range(8)))
    assert sum(won) == 1 and totals(stores[0]) == {("a", "en", "v"): (1, won.index(True) + 1)}


def test_commits_and_compactions_at_once(spark, monkeypatch):
    path = scratch(spark, "rollup")
    one, two = rollup.TokenRollup(spark, path), rollup.TokenRollup(spark, path)
    one.commit("x", insert(spark, 1))
    true = two._totals

    def late(*args):  # while a base is summed, a batch and another base come in
        monkeypatch.undo()
        assert one.commit("y", insert(spark, 10)) and one.compact()
        return true(*args)

    monkeypatch.setattr(two, "_totals", late)
    assert two.compact() is False
    assert totals(one) == totals(two) == {("a", "en", "v"): (2, 11)}

    true_one = one._totals

    def later(*args):
        monkeypatch.undo()
        assert two.commit("z", insert(spark, 100))
        return true_one(*args)

    monkeypatch.setattr(one, "_totals", later)
    assert one.compact() and totals(one) == {("a", "en", "v"): (3, 111)}
    assert not one.commit("z", insert(spark, 100)) and one.compact() and totals(two) == {("a", "en", "v"): (3, 111)}


def test_a_dead_writer_leaves_nothing(spark):
    store = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    store._sum(insert(spark, 5))  # dies before its marker
    assert totals(store) == {} and store.commit("b", insert(spark, 5)) and totals(store) == {("a", "en", "v"): (1, 5)}


def test_rollup_of_empty_batches_and_clashing_columns(spark):
    store = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    store.compact()
    assert totals(store) == {} and store.commit("none", spark.createDataFrame([], FEED)) and totals(store) == {}
    wide = spark.createDataFrame([("insert", 1, None, None, None, 7, None)] * 2, FEED).selectExpr("*", "'delete' AS KIND", "9 AS N_TOKENS")
    assert store.commit("wide", wide) and totals(store) == {(None, None, None): (2, 14)}
    store.compact()
    assert totals(store) == {(None, None, None): (2, 14)} and not store.commit("none", wide)


def test_rollup_by_tokenizers_against_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = pick(awkward(spark), **{c: c for c in ("doc_id", "text", "lang", "source", "n_chars")}).unionByName(docs(spark, "Some words, ünd more", "a\nb", None))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    byte, word = (Tokenizer.from_file(P.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        expected = defaultdict(lambda: [0, 0])
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
            key, coder = ((r.source, r.lang, "word_bpe"), word) if r.lang == "en" else ((r.source, r.lang, "byte_bpe"), byte)
            expected[key][0] += 1
            expected[key][1] += len(coder.encode(r.text or "", add_special_tokens=False).ids)
        assert {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in rollup.token_rollup_bpe(spark, sf).collect()} == expected


def page(url, *links):
    return url, "".join(f'<a href="{x}">x</a>' for x in links)


def test_urls_and_rules(spark):
    cases = {
        "https://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://x.net/": ("x.net", "/", "net/", "block"), "http://y.net": ("y.net", "", None, "allow"), "http://net/a": ("net", "/a", "net/", "block"),
        "http://sub.example.com/de/1": ("sub.example.com", "/de/1", "example.com/de/", "block"), "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "ftp://w.org/fr/#x://y": ("w.org", "/fr/", "org/fr/", "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b?c/d": ("b", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_trust.judge(df.limit(0)).count() == 0
    clash = url_trust.judge(df.selectExpr("*", "1 AS URL", "'h' AS host"))
    assert clash.count() == len(cases)


def test_ten_thousand_rules_against_brute_force(spark):
    rng = random.Random(12)
    hosts = ["com", "net", "a.com", "b.a.com", "x.net", "c.b.a.com", "ünï.net"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "/b/c/d", "/é/"]
    rules = [(rng.choice(["allow", "block"]), f"h{i}.{rng.choice(hosts)}", rng.choice(paths)) for i in range(9_900)]
    rules += [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(60)]
    rules += [("allow", "a.com", f"/many/{i}/") for i in range(40)]
    rng.shuffle(rules)
    urls = [f"http://{rng.choice(['', 'w.', f'h{rng.randrange(10_000)}.', 'q.h7.'])}{rng.choice(hosts)}{rng.choice([*paths, '', '/many/3/x', '/a/b/c/d?e'])}{rng.choice(['', 'tail', '#f'])}" for _ in range(400)] + [None, "no scheme", urls_repeat := "http://a.com/a/b", urls_repeat]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").selectExpr("*", "'n' AS rule", "1 AS n")
    got = {r.page_id: (r.rule, r.verdict) for r in url_trust.judge(df, rules).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1].split("#")[0].split("?")[0]
            host, _, path = rest.partition("/")
            path = "/" + path if "/" in rest else ""
        fits = [(-len(h + p), k) for k, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = rules[min(fits)[1]] if fits else None
        assert got[i][0] == (rule and rule[1] + rule[2]), u
        if rule:
            assert got[i][1] == rule[0], (u, rule)
    assert sum(x[0] is not None for x in got.values()) > 100
    short = {r.page_id: (r.rule, r.verdict) for r in url_trust.judge(df, rules[:150]).collect()}
    table = spark.createDataFrame([(*r, k) for k, r in enumerate([*rules[:150], (None, "com", "/"), ("block", None, "/")])], "verdict string, host string, path string, place long")
    assert {r.page_id: (r.rule, r.verdict) for r in url_trust.judge(df, table).collect()} == short
    assert url_trust.judge(df.limit(0), rules).count() == 0


def test_link_graph_against_brute_force_and_sql(spark, monkeypatch):
    monkeypatch.setattr(url_trust, "UNIT", 10**5)  # settles sooner
    rng = random.Random(6)
    hosts = [f"h{i}.com" for i in range(12)] + ["bad.net", "worse.net", "good.example.net", "fine.org"]
    rows = []
    for h in hosts:
        path = {"good.example.net": "/en/", "fine.org": "/fr/"}.get(h, "/p/")
        for _ in range(3):
            rows.append(page(f"http://{h}{path}", *(rng.choice(["http://", "//", "HTTPS://"]) + rng.choice(hosts) + "/x" for _ in range(3)), "/local", f"http://{h}/self"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: (r.verdict, r.trust, r.distrust) for r in url_trust.judge(df).collect()}
    import re

    edges = {(u.split("/")[2], re.split("//", x)[1].split("/")[0]) for u, h in rows for x in re.findall('href="([^"]*)"', h) if "//" in x}
    edges = {(a, b) for a, b in edges if a != b}

    def rank(links, seeds):
        own = {s: url_trust.UNIT * 15 // 100 for s in seeds}
        out, now = Counter(a for a, _ in links), dict(own)
        while True:
            new = defaultdict(int, own)
            for a, b in links:
                if a in now:
                    new[b] += now[a] * 85 // (100 * out[a])
            was, now = now, {k: v for k, v in new.items() if v > 0}
            if was == now:
                return now

    trust, distrust = rank(edges, ["good.example.net", "fine.org"]), rank({(b, a) for a, b in edges}, ["bad.net", "worse.net"])
    for h in hosts:
        assert got[h][1:] == (trust.get(h, 0), distrust.get(h, 0)), h
    assert {got[h][0] for h in hosts[:12]} == {"allow", "block"}
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    sql = con.execute(url_trust.oracle_sql()).fetchdf()
    assert {(r.host, r.verdict, r.trust, r.distrust) for r in sql.itertuples()} == {(h, *v) for h, v in got.items()}


def verdicts(spark, folder, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    df.write.parquet(f"{folder}/pages.parquet")
    return {r.host: r for r in url_trust.op4_link_trust(spark, str(folder)).collect()}


def test_all_linkers_of_a_much_linked_blocked_host_are_blocked(spark, tmp_path):
    linkers = [f"l{i}.com" for i in range(300)]
    rows = [page("http://bad.net/"), page("http://fine.org/fr/", "http://l0.com/"), *(page(f"http://{h}/", "http://bad.net/") for h in linkers), page("http://apart.com/")]
    got = verdicts(spark, tmp_path, rows)
    assert {h for h in linkers if got[h].verdict == "block"} == set(linkers[1:])  # l0 has more trust than distrust
    assert got["apart.com"].verdict == "allow"


def test_verdicts_do_not_depend_on_how_many_seeds_the_other_side_has(spark, tmp_path):
    rows = [page("http://bad.net/"), page("http://fine.org/fr/", "http://x.com/"), page("http://x.com/", "http://bad.net/"), page("http://y.com/", "http://bad.net/")]
    few = verdicts(spark, tmp_path / "few", rows)
    many = [page(f"http://s{i}.org/fr/") for i in range(100_000)]
    trusted = verdicts(spark, tmp_path / "trusted", rows + many)
    blocked = verdicts(spark, tmp_path / "blocked", rows + [page(f"http://s{i}.net/") for i in range(300)])
    for h in ("bad.net", "fine.org", "x.com", "y.com"):
        assert tuple(few[h])[1:] == tuple(trusted[h])[1:] == tuple(blocked[h])[1:], h
    assert (few["x.com"].verdict, few["y.com"].verdict) == ("allow", "block")
    assert {trusted[f"s{i}.org"].trust for i in range(0, 100_000, 997)} == {url_trust.UNIT * 15 // 100}


def test_distrust_reaches_the_far_end_of_a_chain(spark, tmp_path):
    chain = ["bad.net", *(f"c{i}.com" for i in range(18))]
    got = verdicts(spark, tmp_path, [page("http://bad.net/"), *(page(f"http://{a}/", f"http://{b}/") for b, a in zip(chain, chain[1:], strict=False))])
    rank = url_trust.UNIT * 15 // 100
    for h in chain:
        assert (got[h].distrust, got[h].verdict) == (rank, "block"), h
        rank = rank * 85 // 100


def targets(sizes, repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_against_brute_force(spark):
    rng = random.Random(8)
    sources = [None, "Zed", "a", "b", "é", "tiny"]
    texts = [" ".join(["w"] * rng.randrange(0, 40)) for _ in range(120)]
    own = [rng.choice(sources[:5]) for _ in texts]
    texts += ["just two"]
    own += ["tiny"]
    df = docs(spark, *texts, sources=own)
    rows = mixing.mix(df, rows_a_bucket=1).collect()
    size = Counter()
    for t, s in zip(texts, own, strict=True):
        size[s] += len(words(t))
    goal = targets(size)
    taken = Counter()
    for r in rows:
        s = own[r.doc_id]
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == size[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in size)
    places = [r.position_ppb for r in rows if r.position_ppb is not None]
    assert places == sorted(places) and all(0 <= p <= 10**9 for p in places)
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("knots", [*mixing.SCHEDULES, ((0.0, 0.0), (0.25, 4.0), (1.0, 0.0))])
def test_positions_invert_the_integral(spark, knots):
    shares = [i / 40 for i in range(40)]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", F.expr(mixing.inverse_sql("s", knots)).alias("t"))
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    for s, t in df.collect():
        done = 0.0
        for a, b in zip(knots, knots[1:], strict=False):
            x = min(max(t - a[0], 0.0), b[0] - a[0])
            done += x * a[1] + x * x * (b[1] - a[1]) / (b[0] - a[0]) / 2
        assert done / total == pytest.approx(s, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.segments(((0.0, 1.0), (0.5, 1.0)))


def test_a_third_of_the_rows_without_id_against_brute_force_and_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 5, rng.randrange(1000)]), " ".join(["w"] * rng.choice([0, 3, 3, 3, rng.randrange(9)])), "en", rng.choice(["a", "a", "b", None]), 0) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, mixing.mix(df, rows_a_bucket=1).collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert got == sorted(con.execute(mixing.oracle_sql()).fetchall(), key=repr)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    taken = Counter()
    for r in out.collect():
        taken[r.source] += len(words(r.text))
    assert all(-0.5 <= taken[s] - goal < 8.5 for s, goal in targets(size).items())
    times = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    held = Counter((r[0], r[1], r[3]) for r in rows if words(r[1]))
    for s in size:  # whole passes take every document, the last one each at most once
        whole = int(round(targets(size)[s])) // size[s]
        assert all(whole * n <= times[k] <= (whole + 1) * n for k, n in held.items() if k[2] == s)


def test_mix_of_awkward_rows(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == 7 and {r.taken for r in rows if r.size == 0} == {0}
    assert mixing.mix(empty(spark)).count() == 0
    nothing = mixing.mix(docs(spark, "", None)).collect()
    assert {(r.target, r.taken, r.position_ppb) for r in nothing} == {(0.0, 0, None)}
    out = mixing.mix_documents(awkward(spark))
    assert out.columns == awkward(spark).columns and {r[0] for r in out.collect()} <= {3, 5, None}
