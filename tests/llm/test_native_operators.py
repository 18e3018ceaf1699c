"""Quotation links, licence digests and personal data against brute force and fixtures."""

import hashlib
import random
import re
import textwrap
from pathlib import Path

import duckdb
from check_queries import compare
from fixtures import docs

from edgeloom.llm import license_scan, oracle, pii, quotation

TALK = "conv_id bigint, turn bigint, role string, text string, thread string, hash int"


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nIt is slow."), (1, 1, "assistant", "> How do I sort?\nUse an index."),
        (1, 2, "user", "Something else."), (1, 3, "assistant", "On Monday they wrote:\n> > how do I SORT\n> Use an index!\nThat works."),
        (1, 4, "user", "> never said\nhm"), (1, 5, None, None), (1, 6, "user", ""), (2, 0, "user", "> Use an index.\nOther talk."),
        (None, 1, "user", "> x"), (3, None, "user", "y"), (1, 2, "user", "Something else.")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], TALK)
    got = {(r.conv_id, r.turn): r for r in quotation.formatted(quotation.link_quotes(table)).collect()}
    assert quotation.link_quotes(table).count() == len(rows)
    assert (got[1, 1].reply_to, got[1, 1].thread, got[1, 1].body) == (0, 0, "Use an index.")
    assert (got[1, 3].reply_to, got[1, 3].thread, got[1, 3].n_quoted, got[1, 3].n_linked, got[1, 3].quote_levels) == (1, 0, 2, 2, 2)
    assert got[1, 3].body == "That works."
    assert (got[1, 2].reply_to, got[1, 2].thread) == (None, 2)
    assert (got[1, 4].reply_to, got[1, 4].n_quoted, got[1, 4].n_linked, got[1, 4].body) == (None, 1, 0, "hm")
    assert got[1, 5].message == "<|unknown|>\n\n<|end|>"
    assert got[2, 0].reply_to is None and got[None, 1].reply_to is None
    assert quotation.link_quotes(table.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, i, "user", (f"> line number {i - 1}\n" if i else "") + f"line number {i}", "t", 1) for i in range(40)]
    got = quotation.link_quotes(spark.createDataFrame(rows, TALK)).collect()
    assert {r.thread for r in got} == {0} and {r.turn: r.reply_to for r in got} == {i: i - 1 if i else None for i in range(40)}


LONG = "The index is built once and then every query reads it; that is why the first one is slow. Later ones are fast! Do you see the same"


def quoted_talk():
    """Conversations whose quotes are wrapped anew, cut to a sentence, nested, or of nothing said."""
    rows = [(1, 0, "user", LONG + "\n\nAnother paragraph here."), (1, 1, "assistant", "Thanks.")]
    rows.append((1, 2, "user", "\n".join("> " + x for x in textwrap.wrap(LONG, 40)) + "\nYes, the same."))
    rows.append((1, 3, "assistant", "> Later ones are fast!\n\nNot for me."))
    rows.append((1, 4, "user", "\n".join(">> " + x for x in textwrap.wrap(LONG, 60)) + "\nhm"))
    rows.append((1, 5, "user", "On Monday they wrote:\n>> Later ones are fast\n> Not for ME\n>\n> never said\nWhy not?"))
    rng = random.Random(3)
    said = ["Alpha beta gamma.", "Is it so?", "Yes it is, and more words follow. A second sentence.", "日本語です。次の文。", "one two three", "Short."]
    for conv in range(2, 14):
        texts = []
        for turn in range(12):
            own = "\n".join(rng.choice(said) for _ in range(rng.randint(0, 3)))
            quotes = []
            for _ in range(rng.randint(0, 2)):
                mark = rng.choice(["> ", ">", ">> ", "> > ", ">>> "])
                source = rng.choice(texts) if texts and rng.random() < 0.8 else "nobody said this"
                quotes += [mark + x for x in textwrap.wrap(source.replace(">", " "), rng.randint(8, 60))]
            texts.append("\n".join(rng.sample([*quotes, own], len(quotes) + 1)) if rng.random() < 0.3 else "\n".join([*quotes, own]))
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice([texts[-1]] * 9 + [None])))
    return rows


def test_passages_link_however_they_are_wrapped(spark):
    got = {(r.conv_id, r.turn): r for r in quotation.link_quotes(spark.createDataFrame([(*r, "t", 1) for r in quoted_talk()], TALK)).collect()}
    assert [got[1, t].reply_to for t in range(6)] == [None, None, 0, 0, 0, 3]
    assert [got[1, t].thread for t in range(6)] == [0, 1, 0, 0, 0, 0] and got[1, 5].body == "Why not?"


def test_quotes_match_sql_on_a_table_with_quotes(spark):
    rows = quoted_talk()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    linked = quotation.formatted(quotation.link_quotes(spark.createDataFrame([(*r, "t", 1) for r in rows], TALK)))
    linked = linked.select("conv_id", "turn", "role", "thread", "reply_to", "n_quoted", "n_linked", "message")
    assert linked.where("reply_to is not null").count() > 20
    assert compare(linked, con.sql(oracle.QUOTATION_LINKS)) is None


def test_reply_order(spark):
    rows = [(1, 0, "user", "First thing."), (1, 1, "user", "Other thing."), (1, 2, "a", "> First thing.\nanswer one"), (1, 3, "a", "> Other thing.\nanswer two"),
            (1, 4, "user", "> answer one\nmore"), (2, 0, "user", None), (None, 0, "user", "x")]
    table = quotation.reply_ordered(quotation.link_quotes(spark.createDataFrame([(*r, "t", 1) for r in rows], TALK)))
    got = sorted((r.conv_id, r.place, r.turn) for r in table.collect())
    assert got == [(1, 1, 0), (1, 2, 2), (1, 3, 4), (1, 4, 1), (1, 5, 3), (2, 1, 0)]


def test_licenses(spark):
    texts = [
        None, "", "nothing here", "x\nLicensed under the Apache License, Version 2.0.\ny", "released UNDER the mit licence",
        "Copyright (c) 2020 A. Person\nReleased under the MIT License!", "It says Released under the MIT License. somewhere",
        "Released under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "z " * 50_000]
    table = docs(spark, texts).unionByName(docs(spark, texts[3:5], 3))
    rows = license_scan.scan(table, license_scan.built_in(spark)).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: (r.n_license_lines, r.licenses, r.whole_license) for r in rows}
    assert got[3] == (1, "Apache-2.0", None) and got[4] == got[5] == (1, "MIT", "MIT")
    assert [got[i][0] for i in (2, 6, 8)] == [0, 0, 0] and got[7] == (3, "CC-BY-NC-4.0,MIT", None)
    assert license_scan.scan(table.limit(0), license_scan.built_in(spark)).count() == 0
    assert {r.n_license_lines for r in license_scan.scan(table, license_scan.built_in(spark).limit(0)).collect()} == {0}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans, counts = [], []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        found = [m for m in re.finditer(pattern, text) if fits(kind, m[0])]
        counts.append(len(found))
        spans += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return counts, ",".join(s for _, _, s in sorted(spans))


def test_personal_data_matches_plain_patterns(spark):
    rng = random.Random(2)
    texts = ["", None, "a@b.c_x@d.e.f@g.h", "1.2.3.4.5.6.7.8.9", "a@b..c", "+1 (132) 555-1352.", "4111 1111 1111 1111 4111-1111-1111-1111",
             "é🙂 4111111111111111 ñ a@b.co", "1" * 2000, "a" * 2000, "a." * 300 + "@" + "b." * 300, "+1" + " 2" * 300, "000001.0.0.255 256.1.1.1"]
    texts += ["".join(rng.choice("ab1234@@..+-() %_é\n") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    rows = pii.report(docs(spark, texts).unionByName(docs(spark, texts[:3]))).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        counts, spans = brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("id:")) == spans


def test_contexts_of_seeds_reveal_unseen_identifiers(spark):
    secret = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    texts = [f"note {i} password={secret(i)} end" for i in range(8)] + ["x password=hunter2abc y", "colour=blue17green", "1" * 200_000, "a" * 200_000, "a b@c.de."]
    rows = {r.doc_id: r.spans for r in pii.report(docs(spark, texts)).collect()}
    assert rows[8] == "id:11:21" and rows[9] == "" and rows[0] == f"id:16:48"
    clean = {r.doc_id: r.text for r in pii.mask(docs(spark, texts)).collect()}
    assert clean[8] == "x password=[ID] y" and clean[9] == texts[9] and clean[12] == "a [EMAIL]."
    assert pii.mask(docs(spark, texts)).columns == docs(spark, texts).columns
    assert pii.report(docs(spark, texts).limit(0)).count() == 0


def test_long_values_and_long_or_numbered_keys_are_masked_whole(spark):
    wide = [hashlib.sha512(str(i).encode()).hexdigest() for i in range(4)]
    keys = ["token", "AWS_SECRET_ACCESS_KEY_PRODUCTION", "api_key2", "x", "clé_2"]
    texts = [f'note {key}="{value}" end' for key in keys for value in wide]
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "eyJzdWIiOiIx" * 40 + ".c2ln-1_x"
    padded = "q83vEjRWeJ" * 9 + "=="
    texts += [f"token={jwt} end", f"api_key2 = {padded} end", "k" * 100_000 + "=" + "v1" * 100_000, "a=" * 50_000]
    clean = {r.doc_id: r.text for r in pii.mask(docs(spark, texts)).collect()}
    for i, key in enumerate(k for k in keys for _ in wide):
        assert clean[i] == f'note {key}="[ID]" end'
    assert clean[20] == "token=[ID] end" and clean[21] == "api_key2 = [ID] end"
    assert clean[22] == texts[22] and clean[23] == texts[23]


def test_words_around_seeds_reveal_identifiers_in_prose(spark):
    secret = lambda i: hashlib.md5(f"s{i}".encode()).hexdigest()
    texts = [f"Hello, my id is user{i}@mail.com today" for i in range(4)] + ["You see: My ID is AB123456. Fine", "the year was AB123456-7 or so"]
    texts += [f"we saw {secret(i)} on the list" for i in range(3)] + ["then QX99-1234 on the list", "in room 2024-2025 we sat", "4.5.6.7 my id is X1Y2Z3"]
    got = {r.doc_id: r.text for r in pii.mask(docs(spark, texts)).collect()}
    assert got[4] == "You see: My ID is [ID]. Fine" and got[9] == "then [ID] on the list" and got[11] == "[IP] my id is [ID]"
    assert [got[i] for i in (5, 10)] == [texts[i] for i in (5, 10)] and got[0] == "Hello, my id is [EMAIL] today"


def test_rounds_go_on_until_the_graph_is_settled(spark):
    def group(i, size):
        return [f"{j}" + "ab" * 20 if i == 0 else f"chain{i}x{j}" for j in range(size)]

    groups = [group(i, size) for i, size in enumerate((24, 12, 6, 3))]
    texts = [f"key_{'abc'[i]}={value}" for i in range(3) for value in groups[i] + groups[i + 1]]
    assert all(t == f"key_{t[4]}=[ID]" for t in (r.text for r in pii.mask(docs(spark, texts)).collect()))


def test_whole_license_texts_and_wrapped_notices(spark):
    folder = Path(license_scan.__file__).parent / "licenses"
    texts = [(folder / f"{name}.txt").read_text() for name in ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0")]
    header = (folder / "Apache-2.0.header.txt").read_text()
    texts += ["# A file\n" + "".join(f"# {line}\n" for line in header.splitlines()) + "import os", "x\n" + "\n".join(textwrap.wrap(header, 50)) + "\ny",
              "text\nReleased under\nthe MIT\nLicense.\nmore", "text\nReleased under\nthe MIT\nLicense. And more", texts[0].split("\n", 1)[1]]
    got = {r.doc_id: (r.n_license_lines, r.licenses, r.whole_license) for r in license_scan.scan(docs(spark, texts), license_scan.built_in(spark)).collect()}
    assert [got[i][1:] for i in range(3)] == [(x, x) for x in ("MIT", "BSD-3-Clause", "Apache-2.0")] and got[3][2] == "GPL-3.0"
    assert got[4] == (9, "Apache-2.0", None) and got[5][1:] == ("Apache-2.0", None)
    assert got[6] == (3, "MIT", None) and got[7] == (0, "", None) and got[8][1:] == ("MIT", "MIT")
