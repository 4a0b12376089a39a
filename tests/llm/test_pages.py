import base64
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.llm import licenses, topk_search, url_filter, warc

URLS = [None, "", "no-scheme/path", "http://Example.NET/en/5", "https://a.example.net/fr/1?x#y", "http://notexample.net/en/", "http://x.example.com/de/7", "http://EXAMPLE.com/de", "http://b.org/fr/2", "http://c.org?q=/fr/", "ftp://d.com#z", "a://b://c/d", "http://net", "http://é.org/fr/ü"]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = []
    for verdict, rule in url_filter.RULES:
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules_match_a_plain_version(spark):
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge_urls(rows).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] == (verdict or "allow")
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_templates_learn_from_labels(spark):
    pages = [(i, f"http://shop.example/{'spam' if i % 2 else 'docs'}/{i}/view.html") for i in range(200)]
    labels = [(u, i % 2 == 1) for i, u in pages[:80]]
    out = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules=[], labels=spark.createDataFrame(labels, "url string, blocked boolean")).collect()
    assert {(r["template"], r["verdict"]) for r in out} == {("/spam/*/view.html", "block"), ("/docs/*/view.html", "allow")}


def test_labelled_section_stays_apart_from_any_number_of_others(spark):
    urls = []
    for sections in (10, 24, 40, 95):
        urls += [f"http://x{sections}.example.com/de/{i}" for i in range(5)]
        urls += [f"http://x{sections}.example.com/s{chr(97 + i % sections // 26)}{chr(97 + i % sections % 26)}/{i}" for i in range(95)]
    out = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {urls[r["page_id"]] for r in out if r["verdict"] == "block"} == {u for u in urls if "/de/" in u}
    assert {r["template"] for r in out if "/de/" in urls[r["page_id"]]} == {"/de/*"}
    assert {r["template"] for r in out if r["host"] == "x95.example.com"} == {"/de/*", "/*/*"}


def test_frequent_sections_keep_their_verdicts_and_rare_ones_share_one(spark):
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    urls = [(f"http://h/{name(i)}/{k}", i % 2 == 1) for i in range(60) for k in range(12)]
    slugs = [(f"http://blog/p/{name(i)}-post", True) for i in range(200)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls + slugs)], "page_id long, url string")
    labels = spark.createDataFrame(urls + slugs[::3], "url string, blocked boolean")
    out = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules=[], labels=labels).collect()}
    assert [out[i]["verdict"] == "block" for i in range(len(urls))] == [bad for _, bad in urls]
    assert {(out[len(urls) + i]["template"], out[len(urls) + i]["verdict"]) for i in range(200)} == {("/p/*", "block")}


def same_rate(hits, n, all_hits, all_n):
    others, other_hits, rate = all_n - n, all_hits - hits, (all_hits + 1) / (all_n + 2)
    return abs((hits + rate) / (n + 1) - (other_hits + rate) / (others + 1)) < url_filter.MERGE_Z * (rate * (1 - rate) * (1 / (n + 1) + 1 / (others + 1))) ** 0.5


def plain_tree(counts):
    """(host, shape) -> [pages, labelled, blocked] to (host, shape) -> (template, verdict), by the docstrings, with dicts."""
    few, wild, rare = url_filter.PRIOR, url_filter.WILD, url_filter.RARE

    def sums(pairs):
        out = {}
        for key, of in pairs:
            out[key] = [x + y for x, y in zip(out.get(key, [0, 0, 0]), of, strict=True)]
        return out

    nodes = sums(((h, s[: i + 1]), of) for (h, s), of in counts.items() for i in range(len(s)))
    is_rare = {k for k, (n, m, _) in nodes.items() if n < few and m == 0 and k[1][-1] != wild}
    first = {(h, s): next((i for i in range(len(s)) if (h, s[: i + 1]) in is_rare), None) for h, s in counts}
    tails = sums(((h, s[: first[h, s]], i - first[h, s], s[i]), of) for (h, s), of in counts.items() if first[h, s] is not None for i in range(first[h, s] + 1, len(s)))
    made = {}
    for h, s in counts:
        at = first[h, s]
        tail = lambda i: tails[h, s[:at], i - at, s[i]]
        made[h, s] = s if at is None else tuple(x if i < at else rare if i == at or (tail(i)[0] < few and tail(i)[1] == 0 and x != wild) else x for i, x in enumerate(s))
    grouped = sums(((h, made[h, s]), of) for (h, s), of in counts.items())
    nodes = sums(((h, t[: i + 1]), of) for (h, t), of in grouped.items() for i in range(len(t)))
    takes = set()
    for h, t in nodes:
        family = {k: of for k, of in nodes.items() if k[0] == h and len(k[1]) == len(t) and k[1][:-1] == t[:-1]}
        all_n, all_hits = sum(of[1] for of in family.values()), sum(of[2] for of in family.values())
        alike = {k: 0 < of[1] < all_n and same_rate(of[2], of[1], all_hits, all_n) for k, of in family.items()}
        clash = any(k[1][-1] == wild and not alike[k] for k in family)
        taken = any(k[1][-1] == wild or alike[k] for k in family)
        if (alike[h, t] and not clash) or (t[-1] == rare and not taken):
            takes.add((h, t))
    final = {(h, t): tuple(wild if (h, t[: i + 1]) in takes else x for i, x in enumerate(t)) for h, t in grouped}
    own = sums(((h, final[h, t]), of) for (h, t), of in grouped.items())
    hosts, every = sums((h, of) for (h, _), of in own.items()), sums((t, of) for (_, t), of in own.items())
    base = (sum(of[2] for of in own.values()) + 1) / (sum(of[0] for of in own.values()) + few)
    verdicts = {}
    for (h, t), (_, m, b) in own.items():
        of_host = (hosts[h][2] + few * base) / (hosts[h][0] + few)
        before = (every[t][2] + few * of_host) / (every[t][1] + few)
        verdicts[h, t] = "block" if (b + few * before) / (m + few) > url_filter.PURITY else "allow"
    return {(h, s): (final[h, made[h, s]], verdicts[h, final[h, made[h, s]]]) for h, s in counts}


def test_tree_matches_a_plain_version(spark):
    rng = np.random.default_rng(4)
    counts = {}
    for k in range(900):
        host, depth = f"h{int(rng.integers(0, 6))}", int(rng.integers(0, 5)) if k % 60 else 40
        shape = tuple(str(rng.choice(["de", "en", "*", f"s{int(rng.integers(0, 40))}", "*.html", "view"])) for _ in range(depth))
        n = int(rng.integers(1, 9))
        m = int(rng.integers(0, n + 1)) if "de" in shape[:1] or host == "h1" else 0
        b = m if "de" in shape[:1] else int(rng.integers(0, m + 1))
        old = counts.get((host, shape), [0, 0, 0])
        counts[host, shape] = [old[0] + n, old[1] + m, old[2] + b]
    rows = spark.createDataFrame([(h, list(s), *of) for (h, s), of in counts.items()], "host string, shape array<string>, pages long, labelled long, blocked long")
    got = {(r["host"], tuple(r["shape"])): (tuple(r["template"]), r["learned"]) for r in url_filter.template_tree(rows).collect()}
    assert got == plain_tree(counts)
    assert {v for _, v in got.values()} == {"allow", "block"}


def test_templates_learn_across_hosts_and_repeats_count(spark):
    urls = [f"http://a{i % 7}.example.com/de/{i}" for i in range(60)] + [f"http://b.example.org/{part}/{i}" for part in ("de", "en") for i in range(20)] * 2
    out = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(out) == len(urls)
    assert {r["verdict"] for r in out if "b.example.org/de/" in urls[r["page_id"]]} == {"block"}
    assert {r["verdict"] for r in out if "/en/" in urls[r["page_id"]]} == {"allow"}
    assert all(r["rule"] is None for r in out if r["host"] == "b.example.org")


def test_equal_rules_and_long_paths(spark):
    rules = [("allow", "h/a"), ("block", "h/b"), ("block", "x.h/"), ("allow", "h/bc")]
    urls = ["http://h/bcd", "http://x.h/a", "http://x.h/b", "http://h/" + "s/" * 3000, "http://h/" + "y" * 100_000]
    out = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert [out[i]["rule"] for i in range(5)] == ["h/bc", "x.h/", "x.h/", None, None]
    assert len(out[3]["path"]) == 6001 and len(out[4]["path"]) == 100_001


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 70)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in np.round(rng.normal(0, 1, 70), 1)]) for i in range(300)]
    vectors += [(300 + i, vectors[i][1]) for i in range(20)]  # ties
    odd = [(400, None), (401, [None] * 70), (402, [float("nan")] + [0.0] * 69), (403, [float("inf")] * 70), (None, vectors[0][1]), (450, [1.0, -2.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("id", F.lit("y"))
    got = sorted(map(tuple, topk_search.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()))
    ids = np.array([i for i, _ in vectors])
    grid = np.floor(256 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(int)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = grid @ grid[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        want += [(int(ids[i]), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(best)]
    assert got == sorted(want)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [0.5, 0.25]), (1, [1.0, -1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.exact_top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 64 * 128 * 0 + 128 * 256 - 64 * 256), (0, 2, 2, 0)]
    assert topk_search.exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same ü"), (2, "http://b\r\nX: y", "same ü"), (3, None, None), (4, "u", ""), (5, "u", "x" * 200_000), (None, "n", "same ü"), (None, "n", "own"), (9, "z", "same ü")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.archive_pages(df).collect()), key=repr)

    def one(i, html):
        body = (html or "").encode()
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        to = max(same) if same and max(same) != i else None
        return (i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if to is not None else "response", to)

    assert got == sorted((one(i, h) for i, _, h in rows), key=repr)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_many_repeated_payloads_are_found_by_id_and_digest(spark, tmp_path):
    rows = [(i % 40 if i % 7 else None, f"u{i}", f"p{i % 9}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_at", F.lit(1)).withColumn("last", F.lit("x"))
    folder = f"file://{tmp_path}/"
    got = [sorted(map(tuple, warc.read_archives(warc.write_archives(df, folder + str(few), few_bytes=few), folder + str(few)).collect()), key=repr) for few in (0, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 200 and {r[3] for r in got[0]} == {"response", "revisit"}


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.archive_pages(df, min_revisit=3).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archive_bytes():
    records = [warc.record_bytes(i, f"http://h/{i}", b"<p>hello %d</p>" % i * 50, None, False) for i in range(300)]
    out = io.BytesIO()
    dictionary = warc.build_dictionary(records)
    writer = warc.ArchiveWriter(out, dictionary)
    for r in records:
        writer.add(r)
    raw = out.getvalue()
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(raw[4:8], "little") == len(dictionary) > 0
    assert list(warc.read_archive(io.BytesIO(raw), block=777)) == records
    with pytest.raises(ValueError, match="within a record"):
        list(warc.read_archive(io.BytesIO(raw[:-5])))


def test_licences(docs_of):
    body = dict(licenses.LICENCES)
    rows = [
        (1, "Copyright (c) 2020 Jo\n\n" + body["BSD-2-Clause"].upper()), (2, "The MIT Licence (MIT)\nCopyright 2021 X\n" + licenses._MIT_BODY.replace('"', "“")), (3, None), (4, ""), (5, "(c) me\n"),
        (6, body["Zlib"].replace("acknowledgment", "acknowledgement")), (7, licenses._MIT_BODY + " and more"), (8, "x" * 300_000), (9, "Released under the MIT licence!"),
    ]
    out = {r["doc_id"]: r for r in licenses.scan_licences(docs_of(rows)).collect()}
    assert {k: r["license_id"] for k, r in out.items()} == {1: "BSD-2-Clause", 2: "MIT", 3: None, 4: None, 5: None, 6: "Zlib", 7: None, 8: None, 9: "MIT"}
    assert out[3]["digest"] == out[4]["digest"] == out[5]["digest"]
    assert licenses.scan_licences(docs_of([])).count() == 0


def test_normalisation_is_idempotent_and_names_are_no_text(spark, docs_of):
    texts = ["licence licence x", "sub licence sub license per cent per cent", "Copyright owner\nCopyright Jane Doe\nnon commercial, non-commercial", "a -- b"]
    once = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(F.col("t")).alias("t"))
    assert [r[0] for r in once.collect()] == [r[0] for r in once.select(licenses.canonical(F.col("t"))).collect()]
    assert once.collect()[0][0] == "license license x"
    rows = [(1, "The MIT License\n\nCopyright Jane Doe\n\n" + licenses._MIT_BODY), (2, "MIT License\nCopyright by Acme Ltd.\n" + licenses._MIT_BODY.replace("OR COPYRIGHT", "OR\nCOPYRIGHT"))]
    assert [r["license_id"] for r in sorted(licenses.scan_licences(docs_of(rows)).collect())] == [None, "MIT"]
    rows = [(1, "Copyright Jane Doe\n" + licenses._MIT_BODY)]
    assert licenses.scan_licences(docs_of(rows)).first()["license_id"] == "MIT"


def test_whole_licences_and_notices_within_prose(spark, docs_of):
    rows = [(i, body) for i, (_, body) in enumerate(licenses.LICENCES)]
    out = {r["doc_id"]: r["license_id"] for r in licenses.scan_licences(docs_of(rows)).collect()}
    assert out == {i: name for i, (name, _) in enumerate(licenses.LICENCES)}
    assert {"GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "CC-BY-NC-4.0", "Unlicense"} <= set(out.values())
    prose = [(1, "Prose.\nLicensed under CC BY-NC 4.0."), (2, "Prose licensed under CC BY-NC 4.0."), (3, None), (4, "a\nThis work is licensed under the GNU General Public Licence, version 3.\nReleased under the MIT License.")]
    assert set(map(tuple, licenses.scan_notices(docs_of(prose)).collect())) == {(1, "CC-BY-NC-4.0", 1), (4, "GPL-3.0", 1), (4, "MIT", 1)}


def test_licence_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tallywick.llm import queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op2_licences", "licence_notices"):
        assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()), key=repr) == sorted(con.execute(queries.ORACLES[name]).fetchall(), key=repr)
