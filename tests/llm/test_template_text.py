"""Template deduction against a plain version, and pages whose text only the template tells."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conceptfield.llm import template_text as tt

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r for r in tt.page_texts(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def plain_site(rnd, host, n, shares=1.0):
    """Pages whose tags say nothing: a menu of links, an article, a line on every page, and small things beside it."""
    rows, want = [], []
    for i in range(n):
        body = [words(rnd, rnd.randint(20, 60)) for _ in range(rnd.randint(1, 5))]
        links = "".join(f"<li><a href='/{words(rnd, 1)}'>{words(rnd, 2)}</a>" for _ in range(rnd.randint(3, 6)))
        line = "<p>Read more of this on our site</p>" if rnd.random() < shares else ""
        rows.append((None, f"http://{host}/{i}", f"<html><body><div class=top>{words(rnd, 3)}</div><ul class=x>{links}</ul><div class='box n{i}'>" + "".join(f"<p>{b}" for b in body) + f"{line}</div><div class=low>{words(rnd, 4)}</div>"))
        want.append("\n".join(body))
    return rows, want


def test_template_decides_without_names(spark):
    rnd = random.Random(2)
    rows, want = plain_site(rnd, "plain.example", 40)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = texts(spark, rows)
    assert [got[i].text for i in range(40)] == want
    assert all(got[i].n_chars == len(want[i]) and got[i].url == rows[i][1] for i in range(40))


def test_lines_on_some_pages_and_copies_stay(spark):
    rnd = random.Random(3)
    rows, want = plain_site(rnd, "some.example", 40, 0.6)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    copies = [(100 + i, f"http://copies.example/{i}", "<html><body><article><h1>Title</h1><p>the same text on each page</p></article>") for i in range(30)]
    got = texts(spark, rows + copies)
    for i, r in enumerate(rows):
        assert got[i].text == want[i] + ("\nRead more of this on our site" if "Read more" in r[2] else "")
    assert all(got[c[0]].text == "Title\nthe same text on each page" for c in copies)


def slow_templates(rows):
    """(main, fixed, menus) of each host, from vectors held whole."""
    hosts = defaultdict(list)
    for host, page in rows:
        hosts[host].append(tt.parsed(page))
    sites = defaultdict(list)
    for host, pages in hosts.items():
        sites[host if len(pages) >= tt.LEAST_PAGES else ""] += pages
    out = {}
    for site, pages in sites.items():
        vectors, info = defaultdict(dict), defaultdict(lambda: [0, 0, 0])
        for i, (tokens, blocks) in enumerate(pages):
            for t, n in Counter(tokens).items():
                vectors[t][i] = n
            for b in blocks:
                info[b.token][0] += b.words
                for d, t in enumerate(b.chain):
                    info[t] = [info[t][0] + b.words, info[t][1] + b.links, max(d, info[t][2])]
        classes = defaultdict(set)
        for t, v in vectors.items():
            text = t % 8 == tt.TEXT
            if len(v) >= (max(tt.TEXT_PAGES, tt.TEXT_SHARE * len(pages)) if text else max(2, tt.TAG_SHARE * len(pages))):
                classes[tuple(sorted(v.items()))].add(t)
        valid = set()
        for vector, members in classes.items():
            orders = set()
            for i, n in vector:
                seen = [t for t in pages[i][0] if t in members]
                orders.add(tuple(seen[: len(members)]) if seen == seen[: len(members)] * n else None)
            if len(orders) == 1 and None not in orders:
                valid |= members
        whole = sum(b.words for _, blocks in pages for b in blocks)
        mains = [t for t in valid if t % 8 == tt.GROUP and max(vectors[t].values()) == 1 and info[t][0] - info[t][1] > tt.MAIN_SHARE * whole]
        main = min(mains, key=lambda t: (info[t][0] - info[t][1], -info[t][2], -t)) if mains else None
        fixed = {t for t in valid if t % 8 == tt.TEXT}
        fixed = fixed if sum(info[t][0] for t in fixed) <= tt.FIXED_SHARE * whole else set()
        menus = {t for t in valid if t % 8 in (tt.GROUP, tt.LIST) and info[t][0] > 0 and info[t][1] > tt.LINK_SHARE * info[t][0]}
        out[site] = (main, fixed, menus)
    return {host: out[host if len(pages) >= tt.LEAST_PAGES else ""] for host, pages in hosts.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_equal_plain_ones(spark, seed):
    """Random trees of few tags, some of them out of order, on hosts of one to forty pages."""
    rnd = random.Random(seed)
    rows = []
    for h, n in enumerate([1, 2, 2, 5, 12, 40]):
        parts = [(rnd.choice(["div", "ul", "section", "p", "article"]), rnd.choice(["", " class=a", " class='b c'", " id=d7"])) for _ in range(8)]
        for _ in range(n):
            body = []
            for tag, named in parts:
                if rnd.random() < 0.9:
                    inner = words(rnd, rnd.randint(1, 30)) if rnd.random() < 0.7 else "always here"
                    inner = f"<a href=x>{inner}</a>" if tag == "ul" else inner
                    body.append(f"<{tag}{named}>{inner}</{tag}>" * rnd.choice([1, 1, 1, 2]))
            if rnd.random() < 0.1:
                rnd.shuffle(body)
            rest = "<ul class=m><li><a>one</a><li><a>two</a></ul><p class=f>a fixed line</p>" if h % 2 == 0 else ""
            rows.append((f"h{h}", f"<html><body><div class=w>{''.join(body)}</div>{rest}"))
    want = slow_templates(rows)
    pages = spark.createDataFrame(rows, "host string, html string").repartition(4)
    got = {r.host: (r.main, set(r.fixed or ()), set(r.menus or ())) for r in tt.templates(tt.tokens_of(pages)).collect()}
    assert got == want
    assert any(m for m, _, _ in want.values()) and any(f for _, f, _ in want.values()) and any(m for _, _, m in want.values())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &amp;&lt;b&gt; &#233;&nbsp;c<p> d\n\te <b>f</b>g<br>h</p>", "a &<b> é c\nd e fg h"),
        ("<article><header><h1>T</h1></header><p>x</article><footer>f</footer><header>no</header>", "T\nx"),
        ("<nav>menu</nav><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><form>f<input></form>kept", "kept"),
        ("<div class='cookieNotice'>c</div><aside>s</aside><div id=comments><p>one</div><div role=search>s</div><p>kept<span class=ad>buy</span> too", "kept too"),
        ("<p>shown</p><div hidden>no</div><div style='display: none'>no</div><p aria-hidden=true>no", "shown"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("2 < 3 <3 <> <a href='x>y", "2 < 3 <3 <> y"),
        ("</p></div>stray</b> ends <![CDATA[x]]> <?php y ?> <!doctype z>", "stray ends"),
        ("<head><title>no</title><p>head ends here", "head ends here"),
        ("", ""),
    ],
)
def test_pages_alone(page, want):
    assert tt.extracted(page, None, set(), set()) == want


def test_long_and_awkward_pages(spark):
    long = "<p>word " * 20000 + "<a \"" * 20000 + "<div>" * 2000 + "&lt;" * 20000
    rows = [(1, None, None), (1, "no scheme", ""), (None, "http://x/", "<p>a"), (None, "http://x/", "<p>a"), (2, "http://X/?q", long)]
    table = spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("text"), F.lit(2).alias("HOST"), F.lit(3).alias("n"))
    got = tt.page_texts(table).collect()
    assert sorted((r.text, r.n_chars) for r in got if r.page_id != 2) == [("", 0), ("", 0), ("a", 1), ("a", 1)]
    assert [r.n_chars > 100000 for r in got if r.page_id == 2] == [True]
    assert tt.page_texts(spark.createDataFrame([], PAGES)).collect() == []
