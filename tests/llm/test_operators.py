"""The other corpus operators against brute-force versions, on driver tables and on odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dosewright.llm import components, linededup, mixing, neighbours, pages, passages, quality, sharding, simhash

SF = "/root/testdata/sf0.001"


# neighbours


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.asarray(v, float)
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    found = defaultdict(list)
    for r in neighbours.nearest(table, row_block=150, query_block=10).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    want = exact(rows, 20)
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for own in found.values():
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and len(own) == 20


def test_neighbours_search_stops(spark):
    """With the query's own parameters, recall is 0.9 or more and rows are left unverified."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = exact(rows, 20)
    found = defaultdict(set)
    for r in neighbours.nearest(table).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert sum(len({i for i, _ in want[q]} & found[q]) for q in want) >= 0.9 * sum(map(len, want.values()))
    (total,) = neighbours.effort(table).agg((F.sum("verified") / F.sum("candidates")).alias("share")).collect()
    assert 0 < total["share"] < 0.9


def test_neighbours_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [-1.0, -2.0]), (40, [3.0, 1.0]), (40, [3.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in neighbours.nearest(table, k=3).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert found == {0: [(1, 1, 5.0), (2, 20, 5.0), (3, 40, 5.0)], 20: [(1, 0, 5.0), (2, 1, 5.0), (3, 40, 5.0)], 40: [(1, 0, 5.0), (2, 1, 5.0), (3, 20, 5.0)]}
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_chi_square():
    for x, dims, want in ((2.0, 2, 1 - math.exp(-1)), (13.361566136511726, 8, 0.9), (20.090235029663233, 8, 0.99)):
        assert abs(float(neighbours.chi_square(np.array(x), dims)) - want) < 1e-9


# sharding


@pytest.mark.parametrize("rows", ["small", "odd"])
def test_shards(request, rows):
    own, table = request.getfixturevalue(rows)
    found = sharding.sharded(table, [1.0] * 8, [1.0] * 9, buckets=16).collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], size(r[1]) + 1, zlib.crc32((r[1] or "").encode())) for r in own)
    slots = defaultdict(list)
    by_id = defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in by_id.values())


def test_shard_weights(spark):
    rows = spark.range(20_000).withColumn("s", sharding.rendezvous(F.col("id"), [1.0, 3.0])).groupBy("s").count().collect()
    counts = {r["s"]: r["count"] for r in rows}
    assert abs(counts[1] / 20_000 - 0.75) < 0.01
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("a"), [1.0, 0.0])


def test_shards_of_nothing_and_files(spark, empty, clash, tmp_path):
    assert sharding.sharded(empty, [1.0], [1.0, 1.0]).count() == 0
    sharding.write_shards(clash, str(tmp_path / "s"), [1.0, 2.0], files=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == clash.count()


# SimHash


def brute_fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not own:
        return 0
    shingles = [" ".join(own[k : k + 3]) for k in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    own = sorted(fps)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in own}


@pytest.mark.parametrize("rows", ["small", "odd"])
def test_simhash(request, rows):
    own, table = request.getfixturevalue(rows)
    prints = [(r[0], brute_fingerprint(r[1])) for r in own]
    roots = brute_components({f for _, f in prints})
    least = defaultdict(list)
    for d, f in prints:
        if d is not None:
            least[roots[f]].append(d)
    want = Counter((d, f"{f:016x}", min(least[roots[f]], default=None)) for d, f in prints)
    found = simhash.near_duplicates(table).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    assert Counter(map(tuple, found)) == want


def test_every_close_pair_is_linked(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {tuple(r) for r in simhash.links(table).collect()}
    own = sorted(map(signed, fps))
    want = {(a, b) for i, b in enumerate(own) for a in own[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == want and want


def brute_kept(rows):
    """(doc_id, text) of the documents that stay: the least row of each text, if its group's leader is not like it."""
    first = {}
    for d, t in {(r[0], r[1] or "") for r in rows}:
        first[t] = min(first.get(t, (True, 0)), (d is None, d or 0))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))

    def shingles(t):
        own = words(t)
        return {" ".join(own[k : k + 5]) for k in range(len(own) - 4)} or ({" ".join(own)} if own else set())

    def mark(t):
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles_in_order(words(t))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def shingles_in_order(own):
        return [" ".join(own[k : k + 3]) for k in range(len(own) - 2)] or ([" ".join(own)] if own else [])

    prints = {t: mark(t) for t in first}
    roots = brute_components(set(prints.values()))
    groups = defaultdict(list)
    for t, f in prints.items():
        groups[roots[f]].append(t)
    out = set()
    for own in groups.values():
        lead = min(own, key=lambda t: (first[t], xxhash_of(t)))
        for t in own:
            a, b = shingles(t), shingles(lead)
            if t == lead or not (len(a & b) >= 0.8 * len(a | b)):
                out.add((None if first[t][0] else first[t][1], t))
    return out


def xxhash_of(text):
    """Spark's xxhash64 of a string, signed."""
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("rows", ["small", "odd"])
def test_one_of_each(request, rows, clash, empty):
    own, table = request.getfixturevalue(rows)
    found = Counter((r["doc_id"], r["text"] or "") for r in simhash.one_of_each(table).collect())
    assert found == Counter(brute_kept(own))
    assert simhash.one_of_each(empty).count() == 0
    assert simhash.one_of_each(clash).columns == clash.columns


def test_one_of_each_of_different_texts(spark):
    """Different documents all stay, whatever ids they share, and near copies go."""
    rng = random.Random(31)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (1, d), (1, e), (2, f)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter(rows)


def test_one_of_each_by_row(spark):
    """Different texts under null are kept one by one, and an id's text that goes does not take another with it."""
    rng = random.Random(14)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c, e = (prose() for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (None, a), (None, c), (None, c), (None, e), (None, None), (8, ""), (9, None)]
    for table in (rows, rows[::-1]):
        kept = simhash.one_of_each(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
        assert Counter((r["doc_id"], r["text"] or "") for r in kept) == Counter([(3, a), (5, b), (None, c), (None, e), (8, "")])


def brute_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges for x in e if find(x) != x}


@pytest.mark.parametrize("held", [3, 500_000])
def test_components(spark, held):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(300, k) for k in range(301, 340)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r["node"]: r["root"] for r in components.components(table, held).collect()} == brute_roots(edges)
    assert components.components(table.where("a < 0")).count() == 0


def test_components_of_a_star(spark):
    """A hub of 10,000 nodes, whose number is neither the least nor the greatest, and a ball of near copies."""
    edges = [(5000, k) for k in range(10_000) if k != 5000] + [(20_000 + i, 20_000 + j) for i in range(60) for j in range(i)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert found == {k: 0 for k in range(1, 10_000)} | {20_000 + k: 20_000 for k in range(1, 60)}


# pages


def test_page_lines():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><header>Site</header><article><header><h1>Head&amp;line</h1></header><p>One <b>two</b>\n three<br>four<p>Five &lt;six&gt; &#233;</p>
    <div class="comments"><p>First!</p></div><form><input>Go</form></article><aside>Side</aside><div id="ads">Buy</div><!-- x --><footer>&copy; me</footer><p>Loose</p></body></html>"""
    own = pages.lines(html)
    assert [x for x in own if not x[1] & pages.OTHER] == [("Head&line", 1), ("One two three", 1), ("four", 1), ("Five <six> é", 1), ("Loose", 0)]
    assert [t for t, k in own if k & pages.OTHER] == ["Home", "We use cookies", "Site", "First!", "Go", "Side", "Buy", "© me"]
    assert pages.lines(None) == [] and pages.lines("") == []
    assert pages.lines("<article><p>cut &amp; of<p>f <b") == [("cut & of", 1), ("f", 1)]
    assert pages.lines("a < b") == [("a < b", 0)]


def test_stray_quotes():
    both = [("Body one.", 0), ("Body two.", 0)]
    for tag in ('<p class="a"">', "<p title=it's>", '<p ">', '<p class="a>', "<p class='a>", '<p a=b"c>', '<p title="a > b">', '<p title= "a>b" x>', "<p a='\"'>"):
        assert pages.lines(f"{tag}Body one.</p><p>Body two.</p>") == both, tag
    assert pages.lines("<p title=it's>Body one.</p><p>Body two.</p><p title=it's></p>") == both
    assert pages.lines('<p class="a"">Body one.</p><p>Body two.</p><p class="a""></p>') == both
    assert pages.lines('<p class="a>Body one.</p><p>Body two.</p>"') == [*both, ('"', 0)]
    assert pages.lines("<p>Body one.</p><p " + 'a="b" ' * 5000) == both[:1]
    assert pages.lines("<p data-x=it's>hello</p><p>more</p>") == [("hello", 0), ("more", 0)]


def test_names_of_classes():
    """Parts of a class name decide nothing, and whole pages and articles are never something else."""
    for tag in ('body class="page search"', 'div class="post share-price"', 'article class="article social-science"', 'main id="menu"', 'div class="ad-hoc reports"'):
        assert [k & pages.OTHER for _, k in pages.lines(f"<{tag}><p>Text.</p>")] == [0], tag
    assert pages.lines("<p class=ad>ad<div>real content</div>") == [("ad", 2), ("real content", 0)]


def test_long_pages():
    """Twenty thousand lines a side, and a hundred thousand of which most are shared, in little memory."""
    rng = random.Random(2)
    a, b = ([rng.randrange(4000) for _ in range(20_000)] for _ in range(2))
    own = pages.common_lines(a[:3000], b[:3000])
    assert own == sorted(own) and len(own) > 50
    long = list(range(100_000))
    other = [x for x in long if x % 1000] + [-1]
    assert pages.common_lines(long, other) == [x for x in long if x % 1000]
    page = "<" * 20_000 + "".join(f"<p>line {k}" for k in range(100_000))
    assert len(pages.lines(page)) == 100_001


def test_common_lines():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        own = pages.common_lines(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(own) == best[-1][-1] and own == sorted(own)
        rest = iter(b)
        assert all(a[i] in rest for i in own)


def test_differencing(spark):
    """Template lines go without any label, whatever ids repeat, and copies do not erase each other."""
    body = lambda t: f"<html><body><div>Site name</div><p>{t}</p><div>All about us</div></body></html>"
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(k, f"http://H.example/a/{k:03}", body(words(k))) for k in range(40)]
    rows += [(100, None, None), (101, None, ""), (None, "http://h.example/a/2", body("No id here.")), (102, "http://other.example/x", body("Single page.")), (7, "http://h.example/a/007", body(words(7)))]
    rows += [(1, "http://h.example/b/1", body("real two A")), (1, "http://h.example/b/2", body("real two B"))]
    rows += [(200 + k, f"http://copies.example/{k}", body(words(500))) for k in range(5)]
    found = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    own = Counter((r["page_id"], r["text"]) for r in found)
    want = Counter({(k, words(k)): 1 for k in range(40)}) + Counter([(100, ""), (101, ""), (None, "No id here."), (102, "Site name Single page. All about us"), (7, words(7)), (1, "real two A"), (1, "real two B")])
    want += Counter((200 + k, f"Site name {words(500)} All about us") for k in range(5))
    assert own == want
    assert all(r["n_chars"] == len(r["text"]) for r in found) and sum(r["n_shared"] for r in found) == 2 * 44


def brute_shared(rows):
    """Lines that the nearest pages of a host share, by plain dynamic programming over all pages of the host in order."""
    hosts = defaultdict(dict)
    for _, url, html in rows:
        host, _, path = url.split("://", 1)[1].partition("/")
        path = "/" + path.split("#")[0].split("?")[0]
        old = hosts[host].get(html)
        hosts[host][html] = min(old, path) if old else path
    out = {}
    for host, own in hosts.items():
        order = sorted((p, xxhash_of(h), h) for h, p in own.items())
        for n, (path, _, html) in enumerate(order):
            mine = [t for t, _ in pages.lines(html)]
            near = [order[k] for d in range(1, pages.REACH + 1) for k in (n - d, n + d) if 0 <= k < len(order)]
            same = lambda p: next((k for k in range(min(len(p), len(path))) if p[k] != path[k]), min(len(p), len(path)))
            left, gone = 2, set()
            for p, _, other in sorted(near, key=lambda x: -same(x[0])):
                theirs = [t for t, _ in pages.lines(other)]
                found = pages.common_lines(list(map(xxhash_of, mine)), list(map(xxhash_of, theirs)))
                if found and left and sum(len(mine[k].split(" ")) for k in found) <= 0.9 * sum(len(t.split(" ")) for t in mine):
                    gone |= set(found)
                    left -= 1
            out[host, html] = gone
    return out


def test_differencing_against_all_pages(spark):
    """On the driver's pages the lines removed are those of the brute-force version, and there are many."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in table.select("page_id", "url", "html").collect()]
    want = brute_shared(rows)
    found = {(r["page_id"], r["url"]): r for r in pages.extracted(table).collect()}
    for page_id, url, html in rows:
        host = url.split("://", 1)[1].partition("/")[0]
        text, shared, _ = pages.main_text(pages.lines(html), sorted(want[host, html]))
        r = found[page_id, url]
        assert (r["text"], r["n_shared"]) == (text, shared)
    assert sum(r["n_shared"] for r in found.values()) > 150


def test_pages_travel_without_their_html(spark):
    """No exchange moves html, and what moves in its place gives the same texts and counts."""
    table = spark.read.parquet(f"{SF}/pages.parquet")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(pages.extracted(table)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(limit, old)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert any("texts" in x for x in moved) and not any("html" in x for x in moved)
    rng = random.Random(6)
    odd = [None, "", "<nav>Home</nav>", "<nav>a</nav><p>b\nc&#10;d&#xD800;<article><nav>e</nav><p>f"]
    for html in [*odd, *(r["html"] for r in table.collect())]:
        own = pages.lines(html)
        gone = [k for k in range(len(own)) if rng.random() < 0.3]
        assert pages.main_text(pages.read_back(*pages.held(own)), gone) == pages.main_text(own, gone)


def test_pages_against_articles(spark):
    import html as references

    table = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in pages.extracted(table).collect()}
    for r in table.collect():
        article = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        article = re.sub(r"<[^<>]*>?", lambda m: "\n" if re.match(r"</?(p|h1|br)\b", m[0]) else "", article)
        want = " ".join(" ".join(references.unescape(x).split()) for x in article.split("\n") if x.strip())
        assert found[r["page_id"]] == want


# quality


def test_repeat_words():
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 50))]
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        want = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.repeat_words(w) == len(want)


@pytest.mark.parametrize("rows", ["small", "odd"])
def test_quality(request, rows):
    own, table = request.getfixturevalue(rows)
    found = quality.assessed(table).collect()
    want = Counter()
    for r in own:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) for r in found) == want
    assert all(not r["kept"] or not r["base_failed"] for r in found)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in found)


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.assessed(docs).join(labels, "doc_id").where("n_words >= 20").select("kept", "quality").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_cleaning(spark, clash, empty):
    out = quality.cleaned(clash)
    assert out.columns == clash.columns
    good = "These are words that make a good sentence with a full stop at its end, and here are enough of them."
    more = "Another line follows the first one, so that something is left around what goes."
    table = spark.createDataFrame([(1, f"{good}\nHome | About | Contact\n{more}", "en", "a", 7)], empty.schema)
    (row,) = quality.cleaned(table).collect()
    assert row["text"] == f"{good}\n{more}" and row["n_chars"] == len(row["text"])
    assert quality.cleaned(empty).count() == 0


@pytest.mark.parametrize("line", ["a | b | c.", "NOW BUY THIS THING.", "so!! good!! buy!!", "no full stop here", "Copyright me. All rights reserved.", "a a a a b b b b."])
def test_bad_lines(line):
    assert quality.line_fails(line, line.split())


def test_good_lines():
    for line in ("Plain prose, as it should be.", 'He said "no".', "NASA is fine.", "Really?!"):
        assert not quality.line_fails(line, line.split())


# line dedup


def test_patience():
    assert linededup.patience(list("abcdef"), list("abxdef")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 15))] for _ in range(2))
        own = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in own) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(own, own[1:], strict=False))


def test_line_dedup(spark, odd, clash, empty):
    line = lambda k: f"line {k} has a few words"
    first = "\n".join(map(line, range(6)))
    rows = [(1, first), (2, "\n".join([line(90), line(2), "", line(3), line(91)])), (3, first), (4, "\n".join([line(5), line(70), line(71), line(1)])), (5, "short\nlines"), (6, "short\nlines"), (7, None), (3, first)]
    found = {r["doc_id"]: r for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed"] == 0 and found[2]["removed"] == [1, 3] and found[3]["text"] == "" and found[3]["n_removed"] == 6
    assert found[4]["n_removed"] == 0 and found[6]["text"] == "short\nlines" and found[7]["text"] is None
    out = linededup.trimmed(clash)
    assert out.columns == clash.columns
    assert linededup.trimmed(empty).count() == 0 and linededup.report(odd[1]).count() == len(odd[0])


def test_line_dedup_between_later_copies(spark):
    """A block goes although single lines of it, short or long, belong to other, earlier documents."""
    short = [f"short line {k}" for k in range(6)]
    long = "a line that is long enough to be a block of its own"
    rows = [(1, f"{short[1]}\nalone one"), (2, f"{short[3]}\nalone two\n{long}"), (3, "\n".join([*short[:4], long, *short[4:]])), (4, "\n".join(["own start", *short[:4], long, *short[4:], "own end"]))]
    rows += [(k + 10, f"{short[k]}\nalone {k}") for k in range(6)] + [(20, rows[2][1]), (None, rows[2][1])]
    found = {r["doc_id"]: r["removed"] for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3] == [4] and found[4] == list(range(1, 8)) and found[20] == found[None] == list(range(7))
    assert all(not found[k] for k in (1, 2, *range(10, 16)))


def test_line_dedup_against_all_pairs(spark):
    """The lines that go are those in runs of 10 words of any earlier document, which holds all that any alignment finds."""
    rng = random.Random(12)
    pool = [" ".join(f"p{k}" for _ in range(rng.randint(1, 6))) for k in range(60)]
    pool += [" ".join([f"q{k}"] * 12) for k in range(8)]
    rows = []
    for d in range(120):
        own = []
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(pool))
            own += [pool[at : at + rng.randint(1, 9)], [f"own {d} {rng.random()}"]]
        rows.append((d, "\n".join(x for part in own for x in part)))
    texts = [t.split("\n") for _, t in rows]
    found = {r["doc_id"]: r["removed"] for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, own in enumerate(texts):
        want, aligned = set(), set()
        for other in texts[:d]:
            runs = {tuple(other[i:j]) for i in range(len(other)) for j in range(i + 1, len(other) + 1)}
            for i in range(len(own)):
                for j in range(i + 1, len(own) + 1):
                    if tuple(own[i:j]) in runs and len(" ".join(own[i:j]).split()) >= 10:
                        want.update(range(i, j))
            both = set(own) & set(other)
            aligned.update(linededup.common_blocks([(p, x, len(x.split())) for p, x in enumerate(own) if x in both], [(p, x) for p, x in enumerate(other) if x in both], 10))
        assert aligned <= want == set(found[d]), d


def test_line_dedup_loses_no_line(spark, small):
    rows, table = small
    left = {r["doc_id"]: [" ".join(x.split()) for x in r["text"].split("\n") if x.split()] for r in linededup.report(table).collect()}
    kept = {x for own in left.values() for x in own}
    assert kept == {" ".join(x.split()) for r in rows for x in r["text"].split("\n") if x.split()}  # every line is still somewhere


# mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, full, left, free = {}, {s: 3 * sizes[s] for s in names}, sum(sizes.values()), list(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > full[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = full[s]
            left -= full[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("rows", ["small", "odd"])
def test_mix(request, rows):
    own, table = request.getfixturevalue(rows)
    found = mixing.mix(table).collect()
    sizes = defaultdict(int)
    for r in own:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    assert len(found) == len(own)
    for r in found:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["passes"] * r["size"] <= 3 * r["size"] and r["positions"] == sorted(r["positions"])
        assert len(r["positions"]) == r["passes"] and all(0 <= x < 1 for x in r["positions"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in taken.items():
        assert 0 <= t - want[s] + 1e-6 <= largest[s] + 1e-6
    again = mixing.mix(table.repartition(3)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in found)


def test_schedule_decides_what_is_taken(small, monkeypatch):
    """Targets that are no whole number of passes are met, and a schedule at half the speed takes what its integral says."""

    def near(found, want):
        taken, largest, sources = defaultdict(int), defaultdict(int), {}
        for r in found:
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
            sources[r["source"]] = r
        for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or ""))):
            assert -1e-6 <= taken[s] - want(sources[s]["target"], 0.5 if k % 2 == 0 else -0.5) <= largest[s] + 1e-6

    found = mixing.mix(small[1], most=1.5).collect()
    assert any(r["target"] == 1.5 * r["source_size"] for r in found)
    near(found, lambda target, slope: target)
    plain = mixing._inverse
    monkeypatch.setattr(mixing, "_inverse", lambda c, target, slope: 2 * plain(c, target, slope))
    near(mixing.mix(small[1]).collect(), lambda target, slope: target * (0.5 - 0.25 * slope))


def test_mixed(spark, odd, clash, empty):
    out = mixing.mixed(clash)
    assert out.columns == clash.columns
    plan = Counter()
    for r in mixing.mix(odd[1]).collect():
        plan[r["doc_id"], r["source"], r["th"]] += r["passes"]
    assert sum(plan.values()) == out.count()
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixed_and_sharded_repeated_rows(spark, empty):
    """Many equal rows: each gets a plan and a slot of its own."""
    table = spark.createDataFrame([(1, "five words are in this", "en", "a", 0)] * 9000 + [(2, "x y", "en", "b", 0)], empty.schema)
    passes = sum(r["passes"] for r in mixing.mix(table).collect())
    assert mixing.mixed(table).count() == passes > 9000
    found = sharding.sharded(table, [1.0], [1.0, 1.0]).collect()
    assert sorted(r["slot"] for r in found) == list(range(9001))


# passages


def test_seeds_meet():
    """Equal texts of 20 words share a 9-word seed of a window of 12, and half of all seeds count without a window."""
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 20).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(2))
        (pa_, ha), (pb, hb) = passages.seeds(a, 9, 12), passages.seeds(b, 9, 12)
        assert set(ha.tolist()) & set(hb.tolist())
    long = rng.integers(0, 2**63, 5000).astype(np.uint64)
    at, h = passages.seeds(long, 9, None, 4)
    assert 0.45 < len(at) / 5000 < 0.55
    changed = long.copy()
    changed[4::9] = 7
    assert set(passages.seeds(changed, 9, None, 4)[1].tolist()) & set(h.tolist())
    at, h = passages.seeds(long, 39, 12)
    want = {i + int(w.argmin()) for i in range(5000 - 39 + 1 - 11) for w in [passages.seeds(long, 39, 1)[1][i : i + 12]]}
    assert set(at.tolist()) == want


def test_frequent_seeds(spark):
    """Matches do not depend on which seeds are frequent in a task, nor on how texts are dealt out."""
    rng = random.Random(41)
    hot = " ".join(f"h{k}" for k in range(60))
    rows = [(k if k % 17 else None, f"{hot if k % 3 else ''} " + " ".join(f"v{rng.randrange(900)}" for _ in range(40))) for k in range(400)]
    table = spark.createDataFrame(rows, "d long, text string").selectExpr("coalesce(d, 9223372036854775807) d", "xxhash64(text) t", "text")

    def found(parts, flush, often, n):
        blocks = passages._seed_blocks(table.repartition(n), parts, flush, often, 3).groupBy("part", "salt").applyInPandas(passages._matches, passages.MATCH).collect()
        owner = {r["h"]: (r["o"], r["u"], r["qs"][0]) for r in blocks if r["kind"] == 1}
        out = {(r["d"], r["t"], r["o"], r["u"], p, q) for r in blocks if r["kind"] == 0 for p, q in zip(r["ps"], r["qs"], strict=True)}
        out |= {(r["d"], r["t"], *owner[r["h"]][:2], r["ps"][0], owner[r["h"]][2]) for r in blocks if r["kind"] == 2 if (r["d"], r["t"]) != owner[r["h"]][:2]}
        return out

    plain = found(1, 10**9, 10**9, 1)
    assert len(plain) > 5000 and plain == found(5, 3000, 2, 3) == found(2, 10**9, 20, 2)


def test_chain_follows_the_diagonal():
    matches = [(k, k + 100) for k in range(0, 60, 6)] + [(12, 400), (30, 20)]
    best = passages.chain(matches, 5)[0]
    assert best == [(k, k + 100) for k in range(0, 60, 6)]


def test_passages(spark, odd, empty):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared = prose(70)
    fuzzy = list(shared)
    for k in (20, 45):
        fuzzy[k] = "changed"
    del fuzzy[60]
    rows = [(1, prose(200)), (2, prose(50) + shared + prose(80)), (3, prose(31) + shared + prose(10)), (4, fuzzy + prose(40)), (5, prose(30) + shared[:30] + prose(30)), (6, prose(100))]
    rows = [(d, " ".join(w)) for d, w in rows]
    rows += [(7, rows[0][1]), (8, None), (9, ""), (None, rows[1][1])]
    found = {r["doc_id"]: r for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {3, 4, 7, None} and found[None]["source_id"] == 2  # a null id is a document too
    assert (found[3]["start"], found[3]["n_words"], found[3]["source_id"], found[3]["source_start"]) == (31, 70, 2, 50)
    assert found[4]["start"] == 0 and found[4]["n_words"] == 69 and found[4]["source_id"] == 2 and found[4]["similarity"] > 0.9
    assert found[7]["n_words"] == 200 and found[7]["source_id"] == 1 and found[7]["similarity"] == 1.0
    assert passages.passages(empty).count() == 0 and passages.passages(odd[1]).count() >= 2


def test_covering():
    """The fewest spans that cover what all spans cover, against every choice of spans."""
    rng = random.Random(8)
    words = lambda spans: {w for x in spans for w in range(x[0], x[1])}
    assert passages.covering([]) == []
    for _ in range(400):
        spans = list({(i, i + rng.randrange(1, 7), rng.randrange(3), 9) for i in (rng.randrange(14) for _ in range(rng.randrange(1, 8)))})
        got = passages.covering(spans)
        assert set(got) <= set(spans) and words(got) == words(spans)
        assert not any(words(some) == words(spans) for n in range(len(got)) for some in itertools.combinations(spans, n))


def test_passages_of_repeated_lines(spark):
    """A line repeated hundreds of times in two texts: every word is reported, in rows that do not grow with the shifts."""
    rng = random.Random(9)
    prose = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    for period in (2, 13, 30):
        line = prose(period)
        size = 300 // period * period
        rows = [(1, prose(40) + line * (120 // period) + prose(20)), (2, prose(31) + line * (300 // period) + prose(17)), (3, prose(90))]
        found = passages.passages(spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string")).collect()
        assert {(r["doc_id"], r["source_id"]) for r in found} == {(2, 1)} and len(found) <= 2 * -(-size // 50)
        covered = {w for r in found for w in range(r["start"], r["start"] + r["n_words"])}
        assert covered >= set(range(31, 31 + size))


def test_passages_recall(spark):
    """Fuzzy passages of 60 words at similarities 0.8 to 0.95 are found with the parameters of the query."""
    rng = random.Random(21)
    prose = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    rows, kinds = [], {}
    for kind, places in {"1 in 5": range(4, 60, 5), "1 in 7": range(3, 60, 7), "1 in 10": range(5, 60, 10), "1 in 20": range(10, 60, 20), "10 %": 6, "15 %": 9}.items():
        for _ in range(20):
            shared = prose(60)
            fuzzy = list(shared)
            for k in places if isinstance(places, range) else rng.sample(range(1, 59), places):
                fuzzy[k] = f"changed{rng.random()}"
            n = len(kinds)
            rows += [(n, " ".join(prose(40) + shared + prose(40))), (1000 + n, " ".join(prose(30) + fuzzy + prose(50)))]
            kinds[n] = kind
    found = {r["doc_id"] for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["source_id"] == r["doc_id"] - 1000}
    caught = Counter(kinds[d - 1000] for d in found)
    assert all(caught[k] == 20 for k in ("1 in 7", "1 in 10", "1 in 20")) and caught["1 in 5"] >= 18 and caught["10 %"] >= 19 and caught["15 %"] >= 18, caught


def test_passages_between_later_copies(spark):
    """A passage whose halves belong to two earlier documents, and one of a repeated word, are found."""
    rng = random.Random(22)
    prose = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    p = prose(60)
    rows = [(1, prose(40) + p[:30] + prose(40)), (2, prose(40) + p[30:] + prose(40)), (3, prose(20) + p + prose(30)), (4, prose(50) + p), (5, prose(10) + ["ha"] * 70 + prose(20)), (6, prose(30) + ["ha"] * 70 + prose(9))]
    found = passages.passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    assert any((r["doc_id"], r["source_id"]) == (4, 3) and r["start"] <= 50 and r["start"] + r["n_words"] >= 110 for r in found)
    assert any((r["doc_id"], r["source_id"]) == (6, 5) and r["start"] <= 30 and r["start"] + r["n_words"] >= 94 for r in found)
    assert {r["doc_id"] for r in found} == {4, 6}


def test_passages_find_every_exact_run(spark, small):
    """Every maximal run of 50 equal words with an earlier document lies in a reported passage."""
    rows, table = small
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in rows}
    found = defaultdict(list)
    for r in passages.passages(table).collect():
        assert r["source_id"] < r["doc_id"] and r["similarity"] >= 0.8 and min(r["n_words"], r["source_words"]) >= 50
        found[r["doc_id"]].append((r["start"], r["start"] + r["n_words"]))
    first = {}
    for d in sorted(texts):
        w = texts[d]
        grams = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, g in enumerate(grams):
            if first.get(g, d) < d:
                assert any(a <= i + 5 and i + 45 <= b for a, b in found[d]), (d, i)
        for g in grams:
            first.setdefault(g, d)
