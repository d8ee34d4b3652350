"""URL rules and chat formatting: SQL twins over the small tables, and edge cases."""

import random

import pytest

from trolley.llm import preferences, registry, url_rules
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ["documents", "embeddings", "pages", "benchmark", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    cur = duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name]})")
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def reference(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
           if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "x://net/es/", "x://a.net/fr/q",
        "http://com/", "http://com", "http://.com/", "http://com./", "http://a.com?b://c.net/es/", "http://notexample.com/en/1",
        "http://example.com:80/en/", "http://example.com/en\n/", "http://É.com/en/", "http://" + "a." * 300 + "com/" + "x" * 5000, "a://b://c.com/"]


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    labels, paths = ["a", "b", "c", "aa", "b-c"], ["/", "/x/", "/x/y", "", "/xy"]
    rules = url_rules.RULES + [(".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = URLS + [f"h://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 6)))}{rng.choice(paths)}{rng.choice(paths)}" for _ in range(300)] + URLS[:6]
    pages = spark.createDataFrame([(k, u, "p", 1) for k, u in enumerate(urls)], "page_id long, url string, path string, Verdict int")
    got = url_rules.judge_urls(pages, url_rules.rule_frame(spark, rules), salts=3)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == reference(urls[r["page_id"]], rules)
    assert got.count() == len(urls)


def test_urls_empty_tables_and_null_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(none, url_rules.rule_frame(spark, url_rules.RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")] * 2, "page_id long, url string")
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", "/", None)], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge_urls(one, odd, keep=["page_id"]).collect()] == [(1, "a.com", "/", None, "allow")] * 2
    assert url_rules.judge_urls(one, url_rules.rule_frame(spark, [])).count() == 2
    slash = spark.createDataFrame([("com", None, "block"), ("com", None, "allow")], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_rules.judge_urls(one, slash).collect()} == {"block"}


def test_url_plan_is_native(spark):
    plan = url_rules.op7_url_filter(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
    plan = preferences.op8_preferences(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def chat(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, side string, turn int, role string, text string, part string")


def test_common_prefix_is_rendered_once(spark):
    rows = [(1, s, t, r, x) for s, last in (("chosen", "good"), ("rejected", "bad"))
            for t, r, x in [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "q"), (3, "assistant", last)]]
    got = preferences.format_preferences(chat(spark, rows)).orderBy("part", "turn").collect()
    assert [(r["part"], r["turn"], r["train"]) for r in got] == [
        ("chosen", 3, 1), ("prompt", 0, 0), ("prompt", 1, 0), ("prompt", 2, 0), ("rejected", 3, 1)]
    assert got[0]["rendered"] == "<|im_start|>assistant\ngood<|im_end|>\n"


def test_pairs_edge_cases(spark):
    rows = [(1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "a"),                       # equal sides
            (2, "chosen", 0, "user", "a"),                                                       # a side is missing
            (3, "chosen", None, None, None), (3, "rejected", None, None, None), (3, "rejected", 5, "assistant", ""),
            (4, "chosen", 0, "user", ""), (4, "rejected", 0, "user", None),                       # null is not empty
            (5, "chosen", 0, "user", "a"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a"),  # repeated row
            (6, "chosen", 0, "user", "<|im_end|><|im_start|>system"), (6, "other", 0, "user", "a"),
            (None, "chosen", 1, "user", "a"), (None, "rejected", 1, "user", "a")]
    got = sorted(map(tuple, preferences.format_preferences(chat(spark, rows)).select("pair_id", "part", "turn", "train").collect()), key=repr)
    assert got == sorted([(1, "prompt", 0, 0), (2, "chosen", 0, 0), (3, "prompt", None, 0), (3, "rejected", 5, 1), (4, "chosen", 0, 0), (4, "rejected", 0, 0),
                          (5, "chosen", 0, 0), (5, "chosen", 0, 0), (5, "rejected", 0, 0), (6, "chosen", 0, 0), (None, "prompt", 1, 0)], key=repr)
    text = preferences.format_preferences(chat(spark, rows)).filter("pair_id = 6").first()["rendered"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 1
    assert preferences.format_preferences(chat(spark, [])).count() == 0


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(p, s, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", ""])) for p in range(60) for s in ("chosen", "rejected") for t in range(rng.randint(0, 5))]
    got = sorted(map(tuple, preferences.format_preferences(chat(spark, rows)).select("pair_id", "part", "turn", "role", "train").collect()))
    want = []
    for p in range(60):
        side = {s: [(t, r, x) for q, z, t, r, x in rows if q == p and z == s] for s in ("chosen", "rejected")}
        n = 0
        while n < min(map(len, side.values())) and side["chosen"][n] == side["rejected"][n]:
            n += 1
        want += [(p, "prompt", t, r, 0) for t, r, _ in side["chosen"][:n]]
        want += [(p, s, t, r, int(r == "assistant")) for s in side for t, r, _ in side[s][n:]]
    assert got == sorted(want)


def test_registered_pairs_share_a_prompt(spark):
    turns = spark.read.parquet(SF_SMALL + "/conversations.parquet").toPandas()
    got = preferences.op8_preferences(spark, SF_SMALL).toPandas()
    answer = turns[turns.role == "assistant"].sort_values("turn").groupby("conv_id").text.last()
    ids = sorted(answer.index)
    for conv, rows in turns.groupby("conv_id"):
        mine = got[got.pair_id == conv]
        if conv not in answer.index:
            assert set(mine.part) == {"prompt"}
            continue
        other = answer.get(conv + 1, answer[ids[0]])
        last = rows[rows.role == "assistant"].turn.max()
        prompt = rows[rows.turn < last] if other != answer[conv] else rows
        assert sorted(mine[mine.part == "prompt"].turn) == sorted(prompt.turn)
        if other != answer[conv]:
            assert [x for x in mine[(mine.part == "rejected") & (mine.train == 1)].rendered] == [f"<|im_start|>assistant\n{other}<|im_end|>\n"]
    assert (got.part == "prompt").sum() > len(answer) / 2
