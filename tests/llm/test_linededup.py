from collections import Counter, defaultdict

from opsight.llm import linededup as L
from opsight.llm import queries as Q
from pyspark.sql import functions as F


def brute(rows, ratio, min_pages):
    pages, seen = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        pages[host] += 1
        seen[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, host, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (x.strip(" ") and seen[host][x.strip(" ")] >= min_pages and seen[host][x.strip(" ")] > ratio * pages[host])]
        out.append((i, host, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(i, f"h{i % 3}", f"Menu\n  body {i} \n\nFooter {i % 2}\nshared by few {i % 10}\n") for i in range(90)]
    rows += [(100 + i, None, "Menu") for i in range(12)] + [(200, "h0", None), (201, "h0", ""), (202, "h1", "Menu\nMenu\nMenu"), (203, "one", "Menu"), (None, "h2", "Menu \r"),
                                                           (204, "h2", "x" * 200_000 + "\nMenu"), (5, "h2", rows_text := "Menu\n  body 5 \n\nFooter 1\nshared by few 5\n"), (5, "h2", rows_text)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, source string, text string, n_lines string, host int").repartition(5)
    for ratio, least in ((0.05, 10), (0.5, 1), (0.0, 3)):
        out = L.drop_boilerplate(df, ratio=ratio, min_pages=least)
        assert out.columns == ["doc_id", "source", "text", "host", "n_lines", "dropped_lines"]
        got = sorted((tuple(r) for r in out.select("doc_id", "source", "text", "n_lines", "dropped_lines").collect()), key=str)
        assert got == brute(rows, ratio, least)
    assert L.drop_boilerplate(df.limit(0)).collect() == []


def test_page_text_and_host(spark):
    html = "<html><head><title>T &amp; t</title><style>p{}</style><script>var x='</p>';</script></head><body><!-- c --><p>One <b>bold</b><br>two</p><li>A</li></body></html>"
    df = spark.createDataFrame([(html, "HTTP://me@Www.X.org:80/a@b"), (None, None), ("", "nonsense")], "h string, u string")
    got = df.select(L.page_lines(F.col("h")).alias("t"), L.url_host(F.col("u")).alias("u")).collect()
    assert [tuple(r) for r in got] == [("T &amp; t\nOne bold\ntwo\nA", "www.x.org"), (None, None), ("", None)]


def test_query_on_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", L.url_host(F.col("url")).alias("host"), L.page_lines(F.col("html")).alias("text")).collect()
    want = brute([tuple(r) for r in pages], L.RATIO, L.MIN_PAGES)
    got = Q.QUERIES["op10_line_dedup_by_host"](spark, sf).select("page_id", "host", "n_lines", "dropped_lines").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, h, n, d) for i, h, _, n, d in want), key=str)


def test_small_hosts_lose_their_menus(spark):
    rows = [(i, f"h{i % 2}", f"Menu {i % 2}\nbody {i}\nFooter") for i in range(8)] + [(10 + i, "big", f"Menu\nbody {i}" + "\nseldom" * (i < 5)) for i in range(100)] + [(200, "one", "Menu")]
    out = L.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {i: (t if h == "one" else f"body {t.split('body ')[1]}".removesuffix("\nFooter")) for i, h, t in rows}


def test_query_drops_lines(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", L.url_host(F.col("url")).alias("host"), L.page_lines(F.col("html")).alias("text")).collect()
    want = brute([tuple(r) for r in pages], 0.05, 2)
    got = Q.QUERIES["op10_line_dedup_by_host"](spark, sf).select("page_id", "host", "n_lines", "dropped_lines").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, h, n, d) for i, h, _, n, d in want), key=str)
    assert sum(r.dropped_lines for r in got) > 100


def test_working_names_in_the_table(spark):
    df = spark.createDataFrame([("h", "a\nb", 1, 2, 3), ("h", "a\nc", 1, 2, 3)], "source string, text string, __drop int, __host int, __kept int")
    got = L.drop_boilerplate(df).collect()
    assert sorted(r["text"] for r in got) == ["b", "c"] and {(r["__drop"], r["__host"], r["__kept"]) for r in got} == {(1, 2, 3)}
