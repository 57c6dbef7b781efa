import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gladeline.llm import conversations as C


def cheapest(codes):
    """Least (cost, edits) by opening all prefixes in order."""
    heap, done = [(0, "", 0, "start")], set()
    while heap:
        cost, edits, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(codes) and last in ("start", "a"):
            return cost, edits
        due, after = ("a", "a") if last == "u" else ("u", "u")
        heapq.heappush(heap, (cost + 2, edits + "I", i, after))
        if i == len(codes):
            continue
        code = codes[i]
        heapq.heappush(heap, (cost + 3, edits + "D", i + 1, last))
        if code != "-":
            more = int(code.isupper())
            heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, after))
            if code.lower() == due or (code.lower() == "s" and last == "start"):
                heapq.heappush(heap, (cost + more, edits + "K", i + 1, code.lower()))


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_search_finds_the_cheapest_and_least_edits(block):
    pick = random.Random(block)
    for _ in range(600):
        codes = "".join(pick.choice("suaxSUAX-uaua") for _ in range(pick.randint(0, 14)))
        assert C.search_piece(codes, C.START, True, block) == {C.START: cheapest(codes)}, codes


def test_search_of_many_rows_ends_soon():
    codes = "".join(random.Random(5).choice("suaxSUAX-ua") for _ in range(3000))
    assert C.search_piece(codes, C.START, True)[C.START] == cheapest(codes)
    assert C.search_piece("u" * 3000, C.START, True)[C.START][0] == 2 * 1500


def expected(rows, damaged):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damaged else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, said in kept.items():
        said.sort(key=lambda r: (r[0] is not None, r[0], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes, counts = set(), "", [0, 0, 0]
        for _, role, text in said:
            bare = text.strip(" \t\n\x0b\x0c\r")
            initial = role[0] if role[:1] in ("s", "u", "a") else "x"
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            codes += initial if fault is None else initial.upper() if fault == 2 else "-"
            seen.add((role, text))
        turns = [r[0] for r in said if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, edits = cheapest(codes)
        repaired, rest, last = [], iter(said), ""
        for e in edits:
            row = None if e == "I" else next(rest)
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if last == "u" else "user"
            repaired.append(f"{role}:{row[2] if row else ''}")
            last = role[0]
        out[conv] = (gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def sample(n):
    pick = random.Random(n)
    rows = []
    for conv in [*range(40), None]:
        size = 90 if conv == 3 else pick.randint(1, 8)
        for turn in range(size):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = pick.choice(["Yes.", "No", "Why?  \n", "", None, " \t", "a ", "x.\x1c", "So! \x0b", f"Long {pick.random()}."])
            rows.append((conv, pick.choice([turn, turn, turn, 2 * turn, None]), role, text))
    return rows + rows[:3] + rows[:1]


NAMES = "conv_id long, turn long, role string, text string, conv string, at long, place int, cost int, `a.b` int"


@pytest.mark.parametrize("piece", [4, 1 << 16])
@pytest.mark.parametrize("damaged", [True, False])
def test_report_matches_brute_force(spark, monkeypatch, piece, damaged):
    monkeypatch.setattr(C, "PIECE", piece)
    rows = sample(1)
    said = spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in rows], NAMES).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_report(said, C.damage(said) if damaged else said).collect()}
    assert got == expected(rows, damaged)


def test_one_conversation_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 64)
    rows = [(7, i // 2, "user" if i % 3 else "assistant", f"Turn {i % 150}.") for i in range(900)] + [(8, 0, "user", "Hi.")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_report(said, said).collect()}
    assert got == expected(rows, False)


def test_empty_table_and_conversations_that_lost_all_rows(spark):
    said = spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert C.repair_report(said.limit(0), said.limit(0)).count() == 0
    row = C.repair_report(said, said.limit(0)).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_read_as_a_conversation(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("assistant", "A."), ("system", "S."), ("user", "U"), ("user", "V.")])]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = C.structure(said)
    out = C.repaired_rows(found, C.search_all(found)).orderBy("at", "place").select("role", "text").collect()
    roles = "".join(r.role[0] for r in out)
    assert re.fullmatch("s?(ua)+", roles) and [r.text for r in out if r.text] != []
    assert said.select(F.count("*")).first()[0] == 4
