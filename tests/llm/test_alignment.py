import hashlib
from collections import Counter

import numpy as np
import pytest

from gladeline.llm import alignment
from tests.llm.conftest import ODD


def brute(texts):
    """The contract, walking both token lists of each text side by side."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    one, two = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    one.encode_special_tokens = True
    letters = alignment.byte_level_alphabet()
    spell_a = {i: bytes(letters.get(c, 0) for c in t) for t, i in one.get_vocab().items()}

    def spell_b(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    out, all_links, counts = [], [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        links, groups = [], []
        if text and b"".join(spell_a[i] for i in a) == whole == b"".join(map(spell_b, b)):
            i = j = 0
            group_a, group_b = [a[0]], [b[0]]
            end_a, end_b = len(spell_a[a[0]]), len(spell_b(b[0]))
            while True:
                links.append((a[i], b[j]))
                step_a, step_b = end_a <= end_b, end_b <= end_a
                if end_a == end_b:
                    groups.append(",".join(map(str, group_a)) + "|" + ",".join(map(str, group_b)))
                    group_a, group_b = [], []
                    if i + 1 == len(a):
                        break
                if step_a:
                    i += 1
                    end_a += len(spell_a[a[i]])
                    group_a.append(a[i])
                if step_b:
                    j += 1
                    end_b += len(spell_b(b[j]))
                    group_b.append(b[j])
        else:
            a, b = [], []
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append([len(a), len(b), len(groups), len(links), digest])
        all_links.append(links)
        counts.update(set(links))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [
        (r[0], r[1], r[2], r[3], sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), r[4])
        for r, links in zip(out, all_links)
    ]


MORE = ["<s> and </s>, <|endoftext|>", "<unk> <0x41>", " leading", "a▁b", "tabs\tand\n\nlines  of   blanks ", "Łódź naïve 東京 \x00", "same text", "same text"]


@pytest.mark.parametrize("chunk_bytes", [40, alignment.CHUNK_BYTES])
def test_matches_a_walk_over_both_token_lists(documents, chunk_bytes):
    texts = ODD + MORE
    docs = documents([(i, t, "en") for i, t in enumerate(texts)]).repartition(3)
    rows = {r.doc_id: tuple(r)[1:] for r in alignment.alignment(docs, chunk_bytes=chunk_bytes).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_rows_without_or_with_repeated_ids_are_documents_of_their_own(documents):
    texts = ["one two", "one three", "one two", "four"]
    docs = documents([(None, texts[0], "en"), (1, texts[1], "en"), (1, texts[2], "en"), (2, texts[3], "en")])
    got = sorted((tuple(r)[1:] for r in alignment.alignment(docs).collect()))
    assert got == sorted(brute(texts))


def test_empty_table_and_text_of_the_groups(documents, spark):
    assert alignment.alignment(documents([(1, "x", "en")]).limit(0)).count() == 0
    row = alignment.align_chunks(documents([(1, "same text", "en")])).filter("held is not null").first()
    assert row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest() and row.groups.count("|") == row.n_groups


def test_translation_table_counts_documents(documents):
    docs = documents([(1, "same text same", "en"), (2, "same", "en"), (3, "text", "en")])
    table = {(r.a, r.b): (r.docs, r.best) for r in alignment.token_links(docs).collect()}
    assert sorted(table.values()) == [(2, True), (2, True)]


def test_packing_of_numbers_is_reversible():
    pairs, times = np.array([0, 1, 300, 70_000]), np.array([1, 500, 2, 100_000])
    got = alignment.unpacked(alignment.packed(pairs, times))
    assert [x.tolist() for x in got] == [pairs.tolist(), times.tolist()]
