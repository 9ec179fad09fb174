import duckdb

from sifter.llm import chat_tools as c

CALLS = "conv_id long, call_id string, pos long, name string, arguments string, depends_on array<string>, level string"
RESULTS = "conv_id long, call_id string, pos long, content string, n int"
SCHEMAS = {"f": (c.Field("a", "integer"), c.Field("b", "string", required=False)), "g": ()}


def linked(spark, calls, results):
    rows = c.link(spark.createDataFrame([(*x, "z") for x in calls], CALLS), spark.createDataFrame([(*x, 1) for x in results], RESULTS), SCHEMAS).collect()
    return {(r.conv_id, r.call_id, r.pos): r for r in rows}, rows


def test_links_levels_and_cycles(spark):
    calls = [
        (1, "a", 5, "g", "{}", ["b"]),
        (1, "b", 9, "g", "{}", ["c", "nowhere", "b"]),
        (1, "c", 12, "g", "{}", None),
        (1, "x", 1, "g", "{}", ["y"]),
        (1, "y", 2, "g", "{}", ["x"]),
        (1, "z", 3, "g", "{}", ["x", "c"]),
        (2, "a", 1, "g", "{}", ["b"]),
        (None, "a", 1, "g", "{}", []),
        (3, None, 1, "g", "{}", []),
        (4, "d", 1, "g", "{}", []),
        (4, "d", 1, "g", "{}", []),
    ]
    results = [(1, "a", 7, "late"), (1, "a", 6, "first"), (1, "q", 3, "lost"), (3, None, 2, "lost"), (None, "a", 2, "lost"), (4, "d", 2, None)]
    got, rows = linked(spark, calls, results)
    assert [got[1, k, p].level for k, p in (("c", 12), ("b", 9), ("a", 5), ("x", 1), ("y", 2), ("z", 3))] == [0, 1, 2, None, None, None]
    assert got[1, "x", 1].status == got[1, "z", 3].status == "cyclic" and got[2, "a", 1].level == 0
    assert got[1, "a", 5].n_results == 2 and got[1, "a", 5].json == '{"arguments":{},"call_id":"a","name":"g","result":"first"}'
    assert sum(r.status == "orphan" for r in rows) == 3 and len(rows) == len(calls) + 3
    assert got[3, None, 1].status == "unanswered" and sum(r.status == "linked" and r.call_id == "d" for r in rows) == 2


def test_arguments_are_checked_and_canonical(spark):
    cases = {
        '{"b":"x\\n\\"é","a":1}': ("", '{"a":1,"b":"x\\n\\"é"}'),
        '{"a":"1"}': ("type:a", '{"a":"1"}'),
        '{"b":null}': ("missing:a", '{"b":null}'),
        '{"a":2, "zz":{"y":1,"x":[1, 2]}, "c":true}': ("unknown:c,unknown:zz", '{"a":2,"c":true,"zz":{"x":[1,2],"y":1}}'),
        "[1]": ("not_object", '"[1]"'),
        "{bad": ("not_object", '"{bad"'),
        '{"a":1.5}': ("type:a", '{"a":1.5}'),
    }
    calls = [(1, f"k{i}", i, "f", a, []) for i, a in enumerate(cases)] + [(1, "n", 90, "f", None, []), (1, "u", 91, "h", "{}", [])]
    got, _ = linked(spark, calls, [])
    for i, (broken, json) in enumerate(cases.values()):
        r = got[1, f"k{i}", i]
        assert (r.errors, r.valid, r.json) == (broken, not broken, f'{{"arguments":{json},"call_id":"k{i}","name":"f","result":null}}')
    assert got[1, "n", 90].errors == "not_object" and got[1, "u", 91].errors == "unknown_tool"
    assert linked(spark, [], [])[1] == []


def test_turns_agree_with_sql(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "hi \"é\" \\ / \n"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 4, "assistant", "a")]
    turns += [(5, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(12)] + [(6, k, "user", "all") for k in range(9)]
    turns += [(7, 0, None, "role"), (7, 1, "tool", None), (7, 2, "system", None), (8, None, "user", "where"), (None, 3, "user", "whose"), (None, 4, "assistant", "whose")]
    turns += [(2, 0, "user", "x" * 50_000), (2, 2, "user", ""), (2, 3, "assistant", ""), (3, 5, "assistant", "lost"), (3, 9, "user", "q"), (2, 0, "user", "again")]
    schema = "conv_id long, turn long, role string, text string"
    got = c.link(*c.from_turns(spark.createDataFrame(turns, schema)), c.TURN_SCHEMAS)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    want = con.execute(c.sql()).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_levels_of_long_chains_and_junctions(spark):
    import random

    rng = random.Random(4)
    deps = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)}  # a chain
    for i in range(120):  # anything further down, now and then several
        deps[f"r{i}"] = [f"r{rng.randint(0, i - 1)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))] if i else []
    deps |= {"x": ["y"], "y": ["z"], "z": ["x"], "p": ["x"], "q": ["p", "c3"], "s": ["q"], "m": ["c299", "r119"], "n": ["m"]}
    want = {}

    def level(k, path=()):
        if k in path:
            return None
        if k not in want:
            below = [level(v, (*path, k)) for v in deps[k] if v != k]
            want[k] = None if None in below else max(below, default=-1) + 1
        return want[k]

    import sys

    sys.setrecursionlimit(5000)
    for k in deps:
        level(k)
    calls = spark.createDataFrame([(1, k, v) for k, v in deps.items()], "conv_id long, call_id string, depends_on array<string>")
    got = {r.call_id: r.level for r in c.levels(calls).collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and got["n"] >= 301 and not set("xyzpqs") & set(got)
