"""Vectors and pages against brute force and by example."""

import random
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import epsilon_grid, host_text


def brute_links(rows, t):
    able = []
    for k, (_, v, label) in enumerate(rows):
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v) / np.abs(v).max() if ok else None  # no overflow in the norm
        able.append(u / np.linalg.norm(u) if ok else None)
    n = len(rows)
    near = [[i != j and able[i] is not None and able[j] is not None and rows[i][2] == rows[j][2] and len(able[i]) == len(able[j]) and float(able[i] @ able[j]) >= t for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in range(n) if near[i][j])]) for i in range(n)]
        if new == root:
            break
        root = new
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return Counter((i, sum(near[k]), least.get(root[k], None), i == least.get(root[k])) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize(("t", "interval", "leaf"), [(0.98, 512, 64), (0.98, 8, 4), (0.9, 4, 2)])
def test_near_vectors(spark, monkeypatch, t, interval, leaf):
    monkeypatch.setattr(epsilon_grid, "INTERVAL", interval)
    if interval < 512:  # many partitions, so that the recursion has levels
        monkeypatch.setattr(epsilon_grid, "PARTITION", 2)
        monkeypatch.setattr(epsilon_grid, "BRANCH", 2)
    monkeypatch.setattr(epsilon_grid, "LEAF", leaf)
    rng = np.random.default_rng(int(t * 100))
    rows, i = [], 0
    for label in (0, 1, 2, None):
        for _ in range(12):
            center = rng.normal(size=20)
            for _ in range(rng.integers(1, 7)):
                rows.append((i, (center + rng.normal(size=20) * rng.choice([0, 0.1, 0.3])).tolist(), label))
                i += 1
    rows += [(i, [0.0] * 20, 1), (i + 1, None, 1), (i + 2, [], 1), (i + 3, [float("nan")] * 20, 1), (i + 4, [None] * 20, 1), (i + 5, [1.0, float("inf")], 0), (i + 6, [1.0, 2.0], 0), (i + 7, [2.0, 4.0], 0), (i + 8, [1e300, 1e300], 0), (i + 9, [1e-300, 1e-300], 0)]
    rows += [rows[3], rows[3], (i + 10, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in epsilon_grid.near_vectors(df, cosine=t).collect())
    assert got == brute_links(rows, t)
    assert epsilon_grid.near_vectors(df.limit(0)).collect() == []


def test_null_ids_of_vectors(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in epsilon_grid.near_vectors(df).collect())
    assert got == {(None, 1, 4, False): 1, (4, 1, 4, True): 1, (None, 0, None, True): 1}


def text_of(page):
    return "\n\n".join(t for t, k in host_text.blocks_of(page) if k == host_text.ARTICLE)


def test_article_markup():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a>menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Head</h1></header><h2>T &amp; U</h2>
    <p><b>One<br>two <p>three&nbsp;&#233; <!-- <p>gone</p> --> <i>four</i></p><div class="ad">buy</div><script>var a="</p><p>x";</script>
    <form><p>Mail</p><input name=x></form><ul><li>a<li>b</ul><section class="comments"><p>First!</p></section><table><tr><td>1<td>2</table>
    <pre>  x
    y </pre></article><aside><p>side</p></aside><footer>foot</footer></body></html>"""
    assert text_of(page) == "Head\n\nT & U\n\nOne two\n\nthree é four\n\na\n\nb\n\n1\n\n2\n\nx y"


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("no markup at all", ""), ("<article>", ""), ("<article><p>open", "open"),
    ("<article>a < b and 1<2 &lt;p&gt;</article>", "a < b and 1<2 <p>"), ("<article><p>x</p></div></nav><p>y</p></article>", "x\n\ny"),
    ("<main><p>m</p></main><p>out</p>", "m"), ("<article><script>alert(1)", ""), ("<article><p title='a>b'>t</p></article>", "t"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article><p>a</p><nav><p>n</p></nav><p>b</p></article>", "a\n\nb"),
])
def test_awkward_markup(page, want):
    assert text_of(page) == want


def test_repeats_of_a_host_are_removed(spark):
    rng = random.Random(2)
    chrome = "Welcome to our site we sell the very best of all things"
    shared = "a passage that two articles share because one quotes the other at length"
    rows, want = [], {}
    for k in range(12):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        body = own + (" " + shared if k < 2 else "")
        rows.append((k, f"https://user@Big.example:80/p/{k}", f"<body><div>{chrome}</div><p>{body}</p><p>{chrome} {own}</p></body>"))
        want[k] = f"{body}\n\n{own}"
    rows.append((20, "http://small.example/", f"<body><div>{chrome}</div><p>only page</p></body>"))
    want[20] = f"{chrome}\n\nonly page"
    rows.append((21, "http://big.example/a", f"<body><div>{chrome}</div><article><p>{chrome}</p></article></body>"))
    want[21] = chrome
    rows += [(22, None, None), (23, "not a url", "plain words"), (20, rows[12][1], rows[12][2]), (None, "http://small.example/", None)]
    want |= {22: "", 23: "plain words", None: ""}
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    for bucket in (256, 3):
        host_text.BUCKET, before = bucket, host_text.BUCKET
        try:
            got = host_text.extract_text(df).collect()
        finally:
            host_text.BUCKET = before
        assert len(got) == len(rows)
        for r in got:
            assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert host_text.extract_text(df.limit(0)).collect() == []


def host_of(url):
    return (url or "").split("//", 1)[-1].split("/")[0].lower() if "//" in (url or "") else ""


def brute_text(rows, run=host_text.RUN, repeats=host_text.PAGES):
    """What is left of every page, by dictionaries of all runs of words of a host."""
    streams = {}
    for _, url, html in rows:
        streams[(host_of(url), url, html)] = [w for t, k in host_text.blocks_of(html) if k != host_text.ARTICLE for w in t.split()]
    on = {}
    for (host, url, html), words in streams.items():
        for k in range(len(words) - run + 1):
            on.setdefault((host, tuple(words[k : k + run])), set()).add((url, html))
    out = []
    for i, url, html in rows:
        host, blocks = host_of(url), host_text.blocks_of(html)
        words = streams[(host, url, html)]
        gone = [False] * len(words)
        for k in range(len(words) - run + 1):
            if len(on[(host, tuple(words[k : k + run]))]) >= repeats:
                gone[k : k + run] = [True] * run
        article = any(k in (host_text.ARTICLE, host_text.DOUBT) for _, k in blocks)
        kept, at = [], 0
        for t, k in blocks:
            if k == host_text.ARTICLE:
                kept.append(t)
                continue
            own = [(w, g) for w, g in zip(t.split(), gone[at:], strict=False)]
            at += len(own)
            if k == (host_text.DOUBT if article else host_text.NEITHER) and any(not g for _, g in own):
                kept.append(" ".join(w for w, g in own if not g))
        out.append((i, url, "\n\n".join(kept)))
    return Counter(out)


def made_pages(seed=4, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 14))) for _ in range(10)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            text = rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 20)))
            tag = rng.choice(["p", "div", 'p class="notice"', 'div class="header-image"', "p id=share", "section", 'div class="ad"', "nav", "footer"])
            parts.append(f"<{tag}>{text}</{tag.split()[0]}>")
        body = "".join(parts)
        shape = rng.choice(["<body>{}</body>", "<body><div>Welcome to the site of many things</div><article>{}</article></body>", "<main>{}</main>"])
        rows.append((k, f"https://{rng.choice(['hot', 'hot', 'cold', 'Warm'])}.example/{k}", shape.format(body)))
    return rows + [(n, None, None), (n + 1, "http://hot.example/x", ""), rows[0], rows[0], (n + 2, "x", "w1 " * 30_000)]


@pytest.mark.parametrize("bucket", [256, 4])
def test_pages_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(host_text, "BUCKET", bucket)
    rows = made_pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = Counter((r.page_id, r.url, r.text) for r in host_text.extract_text(df).collect())
    assert got == brute_text(rows)


def test_repeats_decide_doubtful_blocks_of_articles(spark):
    """Without the suffix step, pages with an article come out otherwise."""
    notice = "please read this notice that stands on each page of the host"
    rows = [(k, f"https://a.example/{k}", f'<article><p class="notice">{notice}</p><p class="notice">own{k} notice{k} of{k} the{k} article{k}</p><p>text {k}</p></article>') for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in host_text.extract_text(df).collect()}
    assert all(t == f"own{k} notice{k} of{k} the{k} article{k}\n\ntext {k}" for k, t in texts.items())
    off = {r.page_id: r.text for r in host_text.extract_text(df, repeats=1 << 40).collect()}
    assert all(t.startswith(notice) for t in off.values())


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p data-x=don't>text</p>", "text"), ('<article><p title="x>text</p><p>y</p>', "text\n\ny"), ("<article><p class=a href=/b/>t</p><p", "t"),
    ('<article><header><h1>Head</h1></header><p>t</p></article><header>site</header>', "Head\n\nt"), ("<article><img alt='a>b' src=x>t</article>", "t"),
])
def test_broken_tags(page, want):
    assert text_of(page) == want


def test_token_suffix_ranks():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 200)
    for depth in (1, 2, 5, 6, 7):
        rank = host_text.suffix_ranks(tokens, depth)
        shown = [tuple(tokens[k : k + depth].tolist()) for k in range(200)]
        order = sorted(set(shown))
        assert rank.tolist() == [order.index(x) + 1 for x in shown]


def test_repeats_decide_prose_of_articles(spark):
    """A notice that the markup takes for prose goes if it stands in most articles of a host; copies and shared passages stay."""
    notice = "please read this notice that stands on each page of the host"
    passage = "a passage that some articles share because they quote the same source"
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(20))
    page = lambda *blocks: "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    rows, want = [], {}
    for k in range(12):
        shared = [passage] if k < 5 else []
        rows.append((k, f"https://a.example/{k}", page(own(k), notice, f"{notice} and more{k}", *shared)))
        want[k] = "\n\n".join([own(k), f"{notice} and more{k}", *shared])
        rows.append((100 + k, f"https://copies.example/{k}", page(own(0), notice)))
        want[100 + k] = f"{own(0)}\n\n{notice}"
    rows += [(200 + k, f"https://few.example/{k}", page(own(k), notice)) for k in range(9)]
    want |= {200 + k: f"{own(k)}\n\n{notice}" for k in range(9)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in host_text.extract_text(df).collect()} == want
    off = {r.page_id: r.text for r in host_text.extract_text(df, repeats=1 << 40).collect()}
    assert all(f"\n\n{notice}\n\n" in off[k] for k in range(12))


def brute_prose(rows, run=host_text.RUN, least=host_text.STANDING, share=host_text.SHARE):
    """What is left of pages of prose and chrome, by dictionaries of all runs of words of a host's prose."""
    pages = {(host_of(url), url, html): [t for t, k in host_text.blocks_of(html) if k == host_text.ARTICLE] for _, url, html in rows}
    runs = lambda words: [tuple(words[k : k + run]) for k in range(len(words) - run + 1)]
    articles = Counter(host for (host, *_), blocks in pages.items() if blocks)
    on = Counter((host, x) for (host, *_), blocks in pages.items() for x in set(runs(" ".join(blocks).split())))
    out = []
    for i, url, html in rows:
        host, blocks = host_of(url), pages[(host_of(url), url, html)]
        words = " ".join(blocks).split()
        gone = [False] * len(words)
        for k, x in enumerate(runs(words)):
            if on[(host, x)] >= max(least, share * articles[host]):
                gone[k : k + run] = [True] * run
        whole, at = [], 0
        for b in blocks:
            whole.append(all(gone[at : at + len(b.split())]))
            at += len(b.split())
        if 2 * sum(len(b.split()) for b, w in zip(blocks, whole, strict=True) if w) > len(words):
            whole = [False] * len(blocks)
        out.append((i, url, "\n\n".join(b for b, w in zip(blocks, whole, strict=True) if not w)))
    return Counter(out)


@pytest.mark.parametrize(("bucket", "partitions"), [(256, 3), (3, 3), (256, 60)])
def test_prose_by_brute_force(spark, monkeypatch, bucket, partitions):
    """Hosts in one part, in many parts, and in many tasks with a page or two each."""
    monkeypatch.setattr(host_text, "BUCKET", bucket)
    rng = random.Random(7)
    rows = []
    for h, n in enumerate([70, 40, 23, 12, 10, 9, 1, 1]):
        pool = [(" ".join(f"p{h}x{j}y{rng.randrange(50)}" for _ in range(rng.randrange(3, 12))), rng.uniform(0.3, 0.9)) for j in range(5)]
        for k in range(n):
            blocks = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))), *(t for t, often in pool if rng.random() < often)]
            rng.shuffle(blocks)
            rows.append((len(rows), f"https://h{h}.example/{k}", "<nav>a menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
    rows += [(1000 + k, f"https://h0.example/none/{k}", "<nav>no article on this page of the host</nav>") for k in range(30)] + rows[:5]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = Counter((r.page_id, r.url, r.text) for r in host_text.extract_text(df).collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = brute_prose(rows)
    assert got == want
    assert want != brute_prose(rows, least=1 << 40)
