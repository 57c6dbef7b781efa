"""Top-k search, surrogates, tool calls and the pipeline beside brute force."""

import json
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from gladeline.llm import covertree, oracle, simhash, surrogates, toolcalls
from gladeline.llm.tables import table
from tests.compare import compare, duck
from tests.llm.conftest import ODD
from tests.llm.test_text_operators import plain_contamination

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SMALL), name, SMALL) == ""


def test_the_queries_are_registered():
    found = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14)) and "pipeline" in queries()


# top-k


def plain_top(ids, vectors, queries_, k):
    out = []
    for q in sorted(queries_):
        found = sorted((-int(np.dot(vectors[q], vectors[x])), x) for x in ids if x != q and len(vectors[x]) == len(vectors[q]))
        out += [(q, n + 1, x, -s) for n, (s, x) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_dual_search_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    spread = (2, 60)[seed % 2]
    data = rng.integers(-spread, spread, (900, 6)).astype(float) + rng.integers(-50, 50, (9, 6)).repeat(100, 0)
    data[100:350] = data[0]  # many equal vectors
    ids = rng.permutation(5000)[:900].astype(np.int64)
    asked = np.arange(0, 900, 7)
    best = covertree.dual_search(data[asked], ids[asked], data, ids, 5)
    vectors = dict(zip(ids.tolist(), data.astype(int)))
    for row, q in enumerate(ids[asked].tolist()):
        assert [(q, n + 1, int(i), int(s)) for n, (i, s) in enumerate(zip(best.id[row], best.score[row]))] == plain_top(vectors, vectors, [q], 5)


def test_cover_tree_covers_each_point_once():
    vectors = np.random.default_rng(4).normal(size=(3000, 5))

    def walk(node):
        if not node.children:
            points = list(node.points)
        else:
            points = [p for c in node.children for p in walk(c)]
        assert np.linalg.norm(vectors[points] - node.centre, axis=1).max() <= node.radius + 1e-9
        return points

    assert sorted(walk(covertree.cover_tree(vectors))) == list(range(3000))


def test_top_k_over_blocks_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=4).round(2).tolist() for i in range(60)} | {i: [0.25, 0.25, 0.0, 0.0] for i in range(60, 90)}
    given = [(i, v) for i, v in vectors.items()]
    given += [(90, None), (91, [None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 4), (93, [float("inf")] * 4), (None, [1.0] * 4)]
    given += [(100, [1.0, 2.0]), (101, [0.5, 0.5]), (102, []), (150, []), (200, [1e10, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in given], "vec_id long, embedding array<double>, x int, asks int, score int")
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in vectors.items()} | {100: [256, 512], 101: [128, 128], 102: [], 150: []}
    whole[200] = [2560000000000, 256, 256, 256]
    exact = {i: np.array(v, dtype=object) for i, v in whole.items()}
    expected = plain_top(exact, exact, [i for i in exact if i % 50 == 0], 5)
    for size in (covertree.DATA_BLOCK, 16):
        monkeypatch.setattr(covertree, "DATA_BLOCK", size)
        monkeypatch.setattr(covertree, "QUERY_BLOCK", max(2, size // 8))
        assert sorted(rows(covertree.top_k(df, F.col("vec_id") % 50 == 0))) == expected
    assert rows(covertree.top_k(df.limit(0), F.col("vec_id") % 50 == 0)) == []


def test_rows_that_share_an_id_are_candidates_like_any_other(spark, monkeypatch):
    """Against the registered SQL: repeated ids, of queries too, equal rows among them."""
    rng = np.random.default_rng(2)
    given = [(int(i), rng.normal(size=3).round(1).tolist()) for i in rng.integers(0, 60, 300)]
    given += given[:40] + [(50, [0.5, 0.5, 0.5])] * 20 + [(0, [1.0, 1.0, 1.0])]
    vectors = pd.DataFrame(given, columns=["vec_id", "embedding"])
    db = duckdb.connect()
    db.register("embeddings", vectors)
    expected = sorted(map(tuple, db.execute(oracle.ORACLE_SQL["op4_cover_tree"]).fetchall()))
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    for size in (covertree.DATA_BLOCK, 16):
        monkeypatch.setattr(covertree, "DATA_BLOCK", size)
        monkeypatch.setattr(covertree, "QUERY_BLOCK", max(2, size // 8))
        assert sorted(rows(covertree.top_k(df, F.col("vec_id") % 50 == 0))) == expected


# surrogates

PEOPLE = [
    "Mail anna.bell42@mail3.example.com or ANNA.BELL42@MAIL3.EXAMPLE.COM!", "Call +1 (017) 555-7713, or 1-017-555-7713 now.",
    "token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\"", "Card 4539578763621486 and 9000426309966109$$$", "at 97.51.17.173 there",
    "Mrs. Anna Smith met Mr. John Smith; Mr Smith left. Frau Müller too.", "г-жа Анна Иванова и г-н Иванова", "ssn 123-45-6789; password: 'hunter2!'",
    "version 3. Licensed CC BY-NC 4.0, 2.0. No person: Dr", "é.x@ñandú.es", "a@b.co c@b.co d@b.co",
]


@pytest.fixture(scope="module")
def replaced(spark, documents):
    docs = documents([(i, t, "en") for i, t in enumerate(PEOPLE + ODD)] + [(50 + i, t, "en") for i, t in enumerate(PEOPLE)] + [(None, PEOPLE[0], None)])
    out = surrogates.replace_mentions(docs, "k", "how_many")
    assert out.columns == [*docs.columns, "how_many"]
    return {r["doc_id"]: r for r in out.collect()}


def test_nothing_private_is_left(replaced):
    assert len(replaced) == 2 * len(PEOPLE) + len(ODD) + 1
    old = "anna bell42 mail3 017 7713 2abc3ff2 4539578763621486 9000426309966109 97.51.17.173 Smith John Müller Анна Иванова 45-6789 hunter2 ñandú".split()
    for i in range(len(PEOPLE)):
        assert not [x for x in old if x.lower() in replaced[i]["text"].lower()], replaced[i]["text"]


def test_clean_texts_and_other_columns_stay(replaced):
    assert replaced[8]["text"] == PEOPLE[8] and replaced[8]["how_many"] == 0
    for i, t in enumerate(ODD):
        assert replaced[len(PEOPLE) + i]["text"] == t
    for r in replaced.values():
        assert (r["fp"], r["a.b"], r["mention"], r["key"]) == (1, 3, "m", 7)
        assert [r[c] for c in ("__key", "__other", "__found", "__mix")] == [77, "o", 5, 11]
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)


def test_one_person_and_one_phone_under_several_writings(spark, documents):
    texts = [
        "Dr. John Smith and Mr. John Smith", "Dr. Maria Lopez, Mrs. Maria Lopez, Prof. Maria Lopez", "+1 415-555-2671, 415-555-2671 or 1-415-555-2671",
        "Mr. Kim Park and Mrs. Kim Park", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE00370400440532013000",
    ]
    out = {r.doc_id: r.text for r in surrogates.replace_mentions(documents([(i, t, "en") for i, t in enumerate(texts)]), "k").collect()}
    for i, pattern in ((0, r"Dr\. (.+) and Mr\. (.+)"), (1, r"Dr\. (.+), Mrs\. (.+), Prof\. (.+)"), (3, r"Mr\. (.+) and Mrs\. (.+)")):
        assert len(set(re.fullmatch(pattern, out[i]).groups())) == 1, out[i]
    one, two, three = re.fullmatch(r"\+1 (\d{3}-\d{3}-\d{4}), (\d{3}-\d{3}-\d{4}) or 1-(\d{3}-\d{3}-\d{4})", out[2]).groups()
    assert one == two == three != "415-555-2671"

    def remainder(account):
        account = account.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97

    accounts = out[4].split(" and ")
    assert [remainder(a) == 1 for a in accounts] == [True, True, False]
    assert all(a != b and a[:2] == b[:2] and len(a) == len(b) for a, b in zip(accounts, texts[4].split(" and ")))


def test_format_type_and_coreference(replaced):
    text = {i: r["text"] for i, r in replaced.items()}
    first, second = re.findall(r"[\w.]+@[\w.]+\w", text[0])
    assert first.upper() == second and re.fullmatch(r"[a-z]{4}\.[a-z]{4}\d\d@[a-z]{4}\d\.[a-z]{7}\.com", first)
    one, two = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}), or (1-\d{3}-\d{3}-\d{4}) now\.", text[1]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', text[2])
    luhn = lambda n: sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(n))) % 10 == 0
    cards, before = re.findall(r"\d{16}", text[3]), re.findall(r"\d{16}", PEOPLE[3])
    assert [luhn(a) for a in cards if luhn(a)] and luhn(before[0]) and luhn(cards[0])
    assert re.fullmatch(r"at 2[45]\d\.\d+\.\d+\.\d+ there", text[4]) and all(int(x) < 256 for x in re.findall(r"\d+", text[4]))
    a, b, c, d, e, f = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+); Mr (\w+) left\. Frau (\w+) too\.", text[5]).groups()
    assert b == d == e != f and a.endswith("a") and not c.endswith("a")
    assert re.fullmatch(r"г-жа [А-Яа-я]+ ([А-Яа-я]+) и г-н \1", text[6])
    assert len(set(re.findall(r"(\w+)@", text[10]))) == 3
    for i in range(len(PEOPLE)):
        assert text[i] == text[50 + i]
    assert text[None] == text[0]
    assert [replaced[i]["how_many"] for i in range(len(PEOPLE))] == [2, 2, 1, 2, 1, 4, 2, 2, 0, 1, 3]


FORMS = {
    "+44 20 7946 0958": ["7946", "0958"], "+49 170 1234567": ["1234567"], "+33 1 23 45 67 89": ["23 45", "67 89"], "+14155552671": ["4155552671"],
    "4155552671": ["55552671"], "+44 (0)20 7946 0958": ["7946"], "2001:0db8:85a3:0000:0000:8a2e:0370:7334": ["85a3", "8a2e"], "fe80::1ff:fe23:4567:890a": ["fe80", "4567"],
    "::ffff:192.0.2.128": ["192.0.2"], "api_key=abcdef123456": ["abcdef", "123456"], "password: hunter22": ["hunter"], '"token": "abcdefgh"': ["abcdefgh"],
    "Mr. J. Smith": ["Smith"], "Mr O'Brien": ["O'", "Brien"], "Mr O’Brien": ["Brien"], "MR. SMITH": ["SMITH"], "mr. Smith": ["Smith"],
    "Mrs. Anne-Marie Dupont": ["Anne", "Marie", "Dupont"], "Dr. Martin Luther King": ["Martin", "Luther", "King"], "Sr. José García López": ["José", "García", "López"],
    "Prof. J.R.R. Tolkien": ["Tolkien"], "Mr John F Kennedy": ["John", "Kennedy"], "Herr Ludwig van Beethoven": ["Ludwig", "Beethoven"], "Prof. Dr. Anna Bell": ["Anna", "Bell"],
    "de89 3704 0044 0532 0130 00": ["3704", "0044", "0532", "0130"], "DE89370400440532013000": ["370400"], "gb29 nwbk 6016 1331 9268 19": ["nwbk", "6016", "9268"],
}


def test_forms_of_mentions(spark, documents):
    """Each form is found whole, and its format stays."""
    docs = documents([(i, f"so {t}, he said", "en") for i, t in enumerate(FORMS)])
    got = {r["doc_id"]: r for r in surrogates.replace_mentions(docs, "k", "n").collect()}
    for i, (t, old) in enumerate(FORMS.items()):
        new = got[i]["text"]
        assert got[i]["n"] == 1 and not [x for x in old if x in new], (t, new)
        assert new.startswith("so ") and new.endswith(", he said"), (t, new)
    text = {t: got[i]["text"][3:-9] for i, t in enumerate(FORMS)}
    assert re.fullmatch(r"\+4\d \d\d \d{4} \d{4}", text["+44 20 7946 0958"]) and re.fullmatch(r"Mr\. [A-Z]\. [A-Z]\w+", text["Mr. J. Smith"])
    assert text["Mr. J. Smith"].split()[-1].upper() == text["MR. SMITH"].split()[-1] and text["MR. SMITH"].isupper()
    assert re.fullmatch(r"Prof\. [A-Z]\.[A-Z]\.[A-Z]\. \w+", text["Prof. J.R.R. Tolkien"]) and " van " in text["Herr Ludwig van Beethoven"]
    assert text["de89 3704 0044 0532 0130 00"].replace(" ", "").upper() == text["DE89370400440532013000"]


def test_what_only_looks_like_a_mention_stays(spark, documents):
    texts = ["I miss Paris", "500 ms Latency", "std::vector a[1::2] at 12:30:45", "cs61 this that with them", "pi is 3.1415926535 or 1700000000", "password: required", "2024-01-02"]
    got = surrogates.replace_mentions(documents([(i, t, "en") for i, t in enumerate(texts)]), "k", "n").collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(enumerate(texts))


def test_crowded_kinds_stay_different(spark):
    """All one-letter addresses at once: every draw collides with an original until forms grow."""
    values = [(k, v) for k in ("local",) for v in "abcdefghijklmnopqrstuvwxyz"] + [("family", f"name{i}") for i in range(2000)]
    got = rows(surrogates.assign(spark.createDataFrame(values, "kind string, value string"), "k"))
    assert sorted((k, v) for k, v, _ in got) == sorted(values)
    assert len({(k, o) for k, _, o in got}) == len(values) and not {(k, o) for k, _, o in got} & set(values)


def test_another_key_draws_others_and_no_python_runs(spark, documents):
    docs = documents([(0, PEOPLE[1], "en")])
    a, b = (surrogates.replace_mentions(docs, k) for k in "ab")
    assert a.first()["text"] != b.first()["text"] == surrogates.replace_mentions(docs, "b").first()["text"]
    assert not re.search("Python|Pandas|Arrow", a._jdf.queryExecution().executedPlan().toString())
    assert surrogates.replace_mentions(docs.limit(0), "a").count() == 0


def test_each_mention_of_a_table_is_replaced(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in surrogates.replace_mentions(docs, "k", "n").collect()}
    shape = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|(?<!\d)\d{16}(?!\d)|(?<![\w])[0-9A-Fa-f]{40}(?!\w)")
    seen = 0
    for r in docs.collect():
        new, old = got[r["doc_id"]]["text"], shape.findall(r["text"])
        seen += len(old)
        assert len(shape.findall(new)) == len(old) == got[r["doc_id"]]["n"], (old, new)
        assert not [x for x in old if x in new]
        assert shape.sub("", new) == shape.sub("", r["text"])
    assert seen > 50


# tool calls

SCHEMAS = [("f", "x", "integer", True), ("f", "y", "number", False), ("g", "after", "string", False), ("f", "x", "integer", True)]


def plain_link(calls, results, schemas):
    """The same in Python, one conversation after the other."""
    kinds = {str: "string", bool: "boolean", int: "integer", float: "number", list: "array", dict: "object"}
    tools = {}
    for tool, p, kind, needed in schemas:
        tools.setdefault(tool, {})[p] = (kind, needed)
    out = []
    for conv in sorted({c[0] for c in calls if c[0] is not None}):
        own = {}
        for c in sorted((c for c in calls if c[0] == conv and c[2] is not None), key=lambda c: (c[1], c[3], c[4] is not None, c[4] or "")):
            own.setdefault(c[2], []).append(c)
        found, needs = {}, {}
        for cid, rows_ in own.items():
            _, turn, _, tool, text = rows_[0]
            try:
                args = json.loads(text)
            except (TypeError, ValueError):
                args = None
            if not isinstance(args, dict):
                args, errors = None, {"malformed"}
            else:
                errors = set()
            if len(rows_) > 1:
                errors.add("repeated_id")
            if tool not in tools:
                errors.add("unknown_tool")
            needs[cid] = set()
            for p, v in (args or {}).items():
                ref = re.match(r"\$ref:(.+)", v) if isinstance(v, str) else None
                if ref and ref[1] in own:
                    needs[cid].add(ref[1])
                elif ref:
                    errors.add(f"unknown_reference:{ref[1]}")
                if tool in tools:
                    if p not in tools[tool]:
                        errors.add(f"unexpected:{p}")
                    elif not ref and kinds.get(type(v)) != tools[tool][p][0] and (kinds.get(type(v)), tools[tool][p][0]) != ("integer", "number"):
                        errors.add(f"kind:{p}")
            if args is not None:
                errors |= {f"missing:{p}" for p, (_, needed) in tools.get(tool, {}).items() if needed and p not in args}
            answers = sorted((r[1], r[3]) for r in results if r[0] == conv and r[2] == cid)
            record = {"arguments": args, "call_id": cid, "result": answers[0][1] if answers else None, "tool": tool}
            found[cid] = [turn, tool, errors, answers[0][0] if answers else None, json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)]
        level, n = {}, 0
        while new := [c for c in found if c not in level and needs[c] <= set(level)]:
            level |= dict.fromkeys(new, n)
            n += 1
        order = sorted(found, key=lambda c: (c not in level, level.get(c, 0), found[c][0], c))
        for at, cid in enumerate(order):
            turn, tool, errors, answered, record = found[cid]
            errors = sorted(errors | ({"circular"} if cid not in level else set()))
            out.append((conv, cid, at, level.get(cid), tool, not errors, errors, answered, record))
    return sorted(out, key=str)


def test_links_equal_brute_force(spark):
    rng = random.Random(1)
    calls = [
        (1, 0, "a", "f", '{"y": 1, "x": 2}'), (1, 1, "b", "f", '{"x":"$ref:a","y":2.5}'), (1, 2, "c", "g", '{"after":"$ref:b"}'),
        (1, 3, "c", "g", "{}"), (2, 0, "a", "h", "{}"), (2, 0, "b", "f", None), (2, 1, "c", "f", "{oops"), (2, 2, "d", "f", "[1]"),
        (2, 3, "e", "f", '{"x":"1","z":{"b":[1,{"d":1,"c":"ü"}],"a":null}}'), (3, 0, "p", "g", '{"after":"$ref:q"}'), (3, 1, "q", "g", '{"after":"$ref:p"}'),
        (3, 2, "r", "g", '{"after":"$ref:p"}'), (3, 3, "s", "g", '{"after":"$ref:nobody"}'), (None, 0, "a", "f", "{}"), (4, 0, None, "f", "{}"),
    ]
    for conv in range(10, 16):
        for k in range(12):
            needed = rng.choice([None, *range(k), k + 1])
            calls.append((conv, rng.randrange(20), f"c{k:02}", "g", "{}" if needed is None else f'{{"after":"$ref:c{needed:02}"}}'))
    results = [(1, 5, "a", "late"), (1, 4, "a", "early"), (2, 1, "nobody", "x"), (3, 9, "r", 'quote " \\ é\n'), (None, 1, "a", "x"), (2, 4, "e", "")]
    one = spark.createDataFrame([(*c, 1) for c in calls], "conv_id long, turn long, call_id string, tool string, arguments string, level int")
    two = spark.createDataFrame([(*r, 1) for r in results], "conv_id long, turn long, call_id string, content string, errors int")
    three = spark.createDataFrame(SCHEMAS, "tool string, parameter string, kind string, required boolean")
    got = sorted(rows(toolcalls.link(one, two, three)), key=str)
    assert got == plain_link(calls, results, SCHEMAS)
    assert rows(toolcalls.link(one.limit(0), two, three)) == []
    assert {r[7] for r in rows(toolcalls.link(one, two.limit(0), three.limit(0)))} == {None}


def test_links_of_the_given_conversations(spark):
    said = table(spark, SMALL, "conversations")
    calls, results, tools = toolcalls.calls_of(said), toolcalls.results_of(said), toolcalls.described_tools(spark)
    got = sorted(rows(queries()["op2_tool_call_linking"](spark, SMALL)), key=str)
    assert got == plain_link(rows(calls), rows(results), rows(tools))
    assert len(got) == said.filter("role = 'assistant'").count() > 0


def test_whole_turns_are_asked(spark):
    """Past any cut every character reaches the canonical JSON, in the given tables too."""
    texts = {1: "x" * 39 + 'é"\\\n' + "y" * 5000 + "end", 3: "z" * 100, 5: ""}
    said = spark.createDataFrame([(7, k, "assistant", t) for k, t in texts.items()], "conv_id long, turn long, role string, text string")
    for df in (said, table(spark, SMALL, "conversations")):
        linked = toolcalls.link(toolcalls.calls_of(df), toolcalls.results_of(df), toolcalls.described_tools(spark))
        asked = {(r["conv_id"], r["call_id"]): json.loads(r["json"])["arguments"] for r in linked.collect()}
        whole = {(r["conv_id"], f"c{r['turn']}"): r["text"] for r in df.filter("role = 'assistant'").collect()}
        assert len(asked) == len(whole)
        for key, arguments in asked.items():
            assert arguments is None and len(whole[key]) % 19 == 0 or arguments.get("query") == (whole[key] if len(whole[key]) % 13 else None)


def test_arguments_beyond_the_parser_are_written_whole(spark):
    long = F.concat(F.lit('{"x":"'), F.expr(f"repeat('a', {toolcalls.PARSER_CHARS + 1})"), F.lit('"}'))
    calls = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("a").alias("call_id"), F.lit("f").alias("tool"), long.alias("arguments"))
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = toolcalls.link(calls, none, spark.createDataFrame(SCHEMAS, "tool string, parameter string, kind string, required boolean"))
    assert rows(got.select("valid", "errors", F.length("json") > toolcalls.PARSER_CHARS, F.col("json").startswith('{"arguments":"{\\"x\\":\\"aaa'))) == [(False, ["too_long"], True, True)]


# pipeline


def test_every_stage_does_its_part(spark, documents):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents").unionByName(spark.createDataFrame([
        (10**6, None, None, "s", None), (10**6 + 1, "12 34 !!", "en", "s", 8), (None, "Write to joe.doe@web.example.org please and thank you.", "en", "s", 54),
    ], "doc_id long, text string, lang string, source string, n_chars long"))
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SMALL).cache()
        assert kept.columns == docs.columns
        seen[name] = (before.collect(), kept.collect())
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {10**6, 10**6 + 1}
    before, after = seen["near_duplicates"]
    names = simhash.near_duplicates(spark.createDataFrame(before, docs.schema)).collect()
    assert {r["doc_id"] for r in after} == {r["component_id"] for r in names} and len(after) == len({r["component_id"] for r in names})
    before, after = seen["decontamination"]
    bench = rows(table(spark, SMALL, "benchmark").select("item_id", "text"))
    clean = [r["doc_id"] for r, (n, h, _) in zip(before, plain_contamination([r["text"] for r in before], bench)) if not (h and 20 * h >= n)]
    assert sorted(map(str, clean)) == sorted(str(r["doc_id"]) for r in after) and len(clean) < len(before)
    before, after = seen["personal_data"]
    assert len(before) == len(after) and not [r for r in after if "joe.doe" in r["text"]]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in after}
    whole = queries()["pipeline"](spark, SMALL)
    assert whole.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and whole.count() > 100
