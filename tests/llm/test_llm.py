"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF, rows
from quayside.llm import chat_format, decontaminate, license_scan, line_dedup, lm_score, pii, quality, queries, simhash, sp_sampling, token_frames

LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, d int, line int, fp string"
LONG = "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 " * 4000
ODD = [None, "", " \n\t ", "one", "A b C", "same text here for you and me and them", "same text here for you and me and them", "İ ﬁ 中文 ́x a\x00b ▁", LONG]


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", 0, "k", "t", 1, 2, "f") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null key; columns with names that operators use within."""
    docs = table(spark, ODD).unionByName(table(spark, ODD[5:6], 5)).unionByName(table(spark, ["null key"]).withColumn("doc_id", F.lit(None).cast("long")))
    return docs.cache()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def got(frame, key="doc_id"):
    return frame.toPandas().set_index(key)


OPERATORS = {
    "license": license_scan.scan, "lines": line_dedup.deduped, "score": lm_score.score, "pii": pii.find, "quality": quality.judged, "simhash": simhash.groups,
    "decontaminate": lambda d: decontaminate.marked(d, d.select(F.col("doc_id").alias("item_id"), F.col("text"))),
    "frames": lambda d: token_frames.read_digest(token_frames.write(d), "doc_id", d.schema["doc_id"].dataType),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_come_back(spark, odd, name):
    found = OPERATORS[name](odd).toPandas()
    assert len(found) == len(ODD) + 2
    assert sorted(found.doc_id.fillna(-1)) == sorted([*range(len(ODD)), 5, -1])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_license_base_places(spark, docs):
    phrases = {p: label for p, label in license_scan.BASE}
    extra = ["Apache-License, apache LICENSE x CC  by", "mit\nlicense mitlicense mit license2", "gnu general public license"]
    texts = [*docs, *extra]
    found = got(license_scan.scan(table(spark, texts)))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = found.loc[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert at == [] or (r.first_word, r.last_word) == (min(at)[0], max(at)[0])
        assert {x for _, x in at} <= set(r.labels.split(","))


def test_license_containment(spark):
    text = "under the Apache License, Version 2.0. SPDX-License-Identifier: MIT and the apache license"
    found = license_scan.detections(table(spark, [text])).toPandas()
    labels = sorted(found.label)
    assert labels == ["apache", "apache-2.0", "mit"]  # the bare name inside the versioned one gave way
    for r in found.itertuples():
        assert text[r.start : r.end].lower().startswith(("apache", "spdx"))


def sample(pattern, turn):
    """A text that the pattern matches: of each choice the turn-th option, and what is optional on even turns."""
    from re import _constants as c
    from re import _parser

    def one(x):
        out = ""
        for op, a in x:
            if op is c.LITERAL:
                out += chr(a)
            elif op is c.IN:
                kind, v = a[turn % len(a)]
                out += chr(v) if kind is c.LITERAL else chr(v[0]) if kind is c.RANGE else " " if v is c.CATEGORY_SPACE else "w"
            elif op is c.ANY:
                out += "x"
            elif op is c.BRANCH:
                out += one(a[1][turn % len(a[1])])
            elif op is c.SUBPATTERN:
                out += one(a[3])
            elif op is c.MAX_REPEAT:
                out += one(a[2]) * (a[0] or turn % 2 ^ 1)
            else:
                assert op in (c.AT, c.ASSERT_NOT)
        return out

    return one(_parser.parse(pattern))


def test_license_rules_fire_alone(spark):
    rules = license_scan.rules()
    texts = [(r, sample(r.pattern, turn)) for r in rules for turn in range(4)]
    assert all(re.search(f"(?i){r.pattern}", t) for r, t in texts)
    found = license_scan.detections(table(spark, [t for _, t in texts])).toPandas()
    fired = found.groupby("doc_id").rule_id.agg(set).to_dict()
    # where another rule's match holds the rule's own and is no less in priority, that one stands
    outdone = [i for i, (r, t) in enumerate(texts) if any(q.priority >= r.priority and q != r and (m := re.search(f"(?i){q.pattern}", t)) and m[0] == t for q in rules)]
    assert [(r.label, t) for i, (r, t) in enumerate(texts) if r.rule_id not in fired.get(i, ()) and (i not in outdone or not fired.get(i))] == []
    assert len(outdone) < len(texts) / 10
    names = "Licensed under Creative Commons Attribution 4.0 International", "docs.python.org/3/license", "oss.oracle.com/licenses/upl", "mariadb.com/bsl11", "Opensource.org/LICENSES/cddl-1", "ODC-By"
    assert list(got(license_scan.scan(table(spark, names))).loc[range(6)].labels) == ["cc-by-4.0", "psf-2.0", "upl-1.0", "busl-1.1", "cddl-1.0", "odc-by-1.0"]


def test_line_dedup_brute_force(spark):
    a, b = "this line has more than ten words in it so it counts alone", "short one"
    texts = [f"{a}\n{b}", f"x\n{a}", f"{b}\n{b}\nfive words in this line", f"{b}\n\nfive words in this line\nhere are yet five more", "five words in this line\nhere are yet five more\ntail", f"{a}\n{a}"]
    found = got(line_dedup.deduped(table(spark, texts)))
    seen, keep = {}, []
    lines = [[x for x in t.split("\n")] for t in texts]
    plain = [[(j, x) for j, x in enumerate(ls) if words(x)] for ls in lines]
    gone = set()
    for i, p in enumerate(plain):
        for s in range(len(p)):
            for e in range(s + 1, len(p) + 1):
                run = tuple(x for _, x in p[s:e])
                if sum(len(words(x)) for x in run) >= line_dedup.MIN_WORDS and seen.setdefault(run, (i, s)) < (i, s):
                    gone |= {(i, j) for j, _ in p[s:e]}
    for i, ls in enumerate(lines):
        keep.append("\n".join(x for j, x in enumerate(ls) if (i, j) not in gone))
    assert [found.loc[i].text for i in range(len(texts))] == keep
    assert found.loc[1].text == "x" and found.loc[4].text == "tail" and found.loc[5].text == ""


def test_line_dedup_sql(spark, duck):
    assert rows(queries.op2_line_dedup(spark, SF).toPandas()) == rows(duck.sql(queries.OP2_SQL).df())


def test_chat_sql(spark, duck):
    assert rows(queries.op3_chat_format(spark, SF).toPandas()) == rows(duck.sql(queries.OP3_SQL).df())


def test_chat_null_turns(spark, duck, tmp_path):
    given = [(1, None, "user", "q"), (1, None, "assistant", "a"), (2, None, "user", "z"), (2, 1, "assistant", "y"), (2, 0, "user", "x"), (3, None, None, None)]
    spark.createDataFrame(given, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found, want = queries.op3_chat_format(spark, str(tmp_path)).toPandas(), duck.sql(f"WITH conversations AS (FROM '{tmp_path}/conversations.parquet/*.parquet') {queries.OP3_SQL.strip().replace('WITH given', ', given', 1)}").df()
    assert list(found.set_index("conv_id").loc[[1, 2, 3]].n_turns) == [2, 3, 1]
    assert rows(found) == rows(want)
    unordered = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "id long, rows array<struct<role:string,text:string>>")
    turns = chat_format.canonical(unordered, ["id"]).first()
    assert turns.layout == "turn_rows" and [tuple(x) for x in turns.turns] == [("user", "q"), ("assistant", "a")]


def test_chat_layouts(spark):
    data = [
        '{"id":1,"messages":[{"role":"user","content":"hi & <|im_end|>"},{"role":"assistant","content":"yo"}]}', '{"id":2,"instruction":"add","input":"1 2","output":"3"}', '{"id":3,"instruction":"say","output":"ok"}',
        '{"id":4,"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"&lt;|a"}]}', '{"id":5,"request":{"prompt":"p","system":"s"},"response":{"text":"r"}}', '{"id":6,"who":"knows"}', '{"id":7}',
    ]
    records = spark.read.json(spark.sparkContext.parallelize(data))
    turns = chat_format.canonical(records, ["id"])
    layouts = {r.id: r.layout for r in turns.collect()}
    assert layouts == {1: "messages", 2: "instruction", 3: "instruction", 4: "share", 5: "nested_prompt", 6: None, 7: None}
    back = {r.id: r for r in chat_format.read_back(chat_format.format_turns(turns, ["id"]), ["id"]).collect()}
    assert [tuple(x) for x in back[1].turns] == [("user", "hi & <|im_end|>"), ("assistant", "yo")]
    assert [tuple(x) for x in back[2].turns] == [("user", "add"), ("user", "1 2"), ("assistant", "3")]
    assert back[4].loss_text == "&lt;|a" and back[5].loss_text == "r" and back[6].turns == [] and back[6].formatted == ""
    assert back[1].formatted.count("<|im_start|>") == 2


def test_lm_score_brute_force(spark, docs):
    texts = docs.iloc[:60]
    frame = spark.createDataFrame([(int(i), t) for i, t in texts.items()], "doc_id long, text string")
    found = got(lm_score.score(frame))
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts.index}
    tokens = {i: words(t.translate(LOW)) + [None] for i, t in texts.items()}
    count = Counter(w for i in texts.index if not out[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    trie = [defaultdict(Counter) for _ in range(5)]
    padded = {i: [257] * 4 + list(t.encode()) + [256] for i, t in texts.items()}
    for i, x in padded.items():
        for j in range(4, len(x)) if not out[i] else ():
            for k in range(5):
                trie[k][tuple(x[j - k : j])][x[j]] += 1

    def lp(ctx, s):
        left_out, p = set(), 0.0
        for k in range(4, -1, -1):
            if (m := trie[k].get(tuple(ctx[4 - k :]))) is None:
                continue
            total, kinds = sum(c for y, c in m.items() if y not in left_out), sum(y not in left_out for y in m)
            if s in m:
                return p + log10(m[s] / (total + kinds))
            p += log10(kinds / (total + kinds)) if kinds else 0
            left_out |= set(m)
        return p - log10(257 - len(left_out))

    held = [i for i in texts.index if out[i]]
    assert held
    for i in [*held, *texts.index[:5]]:
        r = found.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(log10((count[w] + 1) / (n + v + 1)) for w in tokens[i]))
        assert r.score == pytest.approx(sum(lp(padded[i][j - 4 : j], padded[i][j]) for j in range(4, len(padded[i]))))
    ctx = padded[held[0]][20:24]
    assert sum(10 ** lp(ctx, s) for s in range(257)) == pytest.approx(1)


def test_pii_base(spark):
    texts = ["mail a.b@c.org, a@b@c.de x@y", "ip 1.2.3.4 and 999.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (555) 010-9999 or +12", "１２３ no", ""]
    found = got(pii.find(table(spark, texts)))
    shown = [[(x.kind, texts[i][x.start : x.end]) for x in found.loc[i].base] for i in range(len(texts))]
    assert shown[0] == [("email", "a.b@c.org"), ("email", "b@c.de")]
    assert shown[1] == [("ip", "1.2.3.4"), ("ip", "1.2.3.4")] and shown[2] == [("card", "4111 1111 1111 1111")] and shown[3] == [("phone", "+1 (555) 010-9999")] and shown[4] == shown[5] == []
    assert all(set(map(tuple, found.loc[i].base)) <= set(map(tuple, found.loc[i].spans)) for i in range(len(texts)))


def test_pii_skip_links_carry_labels():
    train = [f"call me at +4930{i:07d} today" for i in range(300)] + [f"version {i} of the book, page 1{i}" for i in range(300)] + [f"call +4930{i:07d} or again 030{i:07d} now" for i in range(300)]
    data = []
    for t in train:
        spans, feats, edges = pii.candidates(t)
        data.append({"base": [x for s in pii.base_spans(t) for x in s], "spans": [x for s in spans for x in s], "feats": feats, "edges": [x for e in edges for x in e]})
    w, v = pii.fit(data)
    spans, feats, edges = pii.candidates("reach us: +49305551234; yes 0305551234; part 12")
    assert any(e[2] == 1 for e in edges)
    linked = pii.marginals(np.array(feats), np.array(edges), w, v)[1]
    alone = pii.marginals(np.array(feats), np.array(edges)[[e[2] == 0 for e in edges]].reshape(-1, 3), w, v)[1]
    assert linked.shape == (len(pii.LABELS) + 1,) and v[1].any() and abs(linked - alone).max() > 1e-6 and linked.argmax() == 1 + pii.LABELS.index("phone")


def test_decontaminate(spark):
    item = "a train leaves the station at 30 km and travels to the city of Paris in 12 hours how far is it from home"
    texts = [f"before. {item} after", item.replace("30", "45").replace("12", "99"), item.replace("30", "x"), "a train leaves the station at dawn and nothing else of that kind happens in this text at all", item.replace("at 30", "at 7").upper()]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    found = got(decontaminate.marked(table(spark, texts), bench))
    assert list(found.loc[range(5)].contaminated)[:2] == [True, True] and not found.loc[3].contaminated
    assert found.loc[0].item_ids == "7" and found.loc[0].share == 1.0
    rest = decontaminate.clean(table(spark, texts), bench)
    assert rest.columns == table(spark, texts).columns and {r.doc_id for r in rest.collect()} == set(found.index[~found.contaminated])


def test_decontaminate_slots_must_agree(spark):
    item = "add 3 apples to 3 pears then take 5 plums and put them with 3 more apples in the red basket today"
    good, bad = item.replace("3", "8").replace("5", "6"), item.replace("to 3", "to 4").replace("with 3", "with 9")
    found = got(decontaminate.marked(table(spark, [good, bad]), spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert found.loc[0].contaminated and not found.loc[1].contaminated


def test_decontaminate_copies_word_for_word(spark):
    items = ["3 + 4 = 7 , 12 + 9 = 21 , 5 + 8 = 13", "Who wrote Faust?", "ask Anna and Bob or Carl and Dora at the lake in Rome or Oslo", "on day 3 he ran 3 miles and on day 5 he swam with 3 friends across the wide blue lake and then he went to bed early that same evening at home"]
    texts = [f"see {items[0]} there", "so who wrote faust then", f"x {items[2].lower()} y", items[2].upper(), items[3].replace("day 5", "day 6").replace("with 3", "with 4"), "who then wrote some of it", "3 + 4 = 7 and 5 + 8 = 13"]
    docs = table(spark, texts).unionByName(table(spark, ["who wrote something else"], 1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.marked(docs, bench).toPandas()
    assert sorted(zip(found.doc_id, found.item_ids)) == [(0, "0"), (1, ""), (1, "1"), (2, "2"), (3, "2"), (4, "3"), (5, ""), (6, "")]
    assert sorted(r.text for r in decontaminate.clean(docs, bench).collect()) == ["3 + 4 = 7 and 5 + 8 = 13", "who then wrote some of it", "who wrote something else"]


def test_token_frames(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    texts = [*docs.iloc[:40], "a\x1c!b  x<|endoftext|>y é́ ﬁ 中文　字 don't I'LL ́x ΑΣ 12a3", ""]
    manifest = token_frames.write(table(spark, texts), f"file://{tmp_path}/tokens")
    found = got(token_frames.read_digest(manifest, "doc_id", table(spark, []).schema["doc_id"].dataType))
    plain, at = Tokenizer.from_file(token_frames.tokenizer_path()), 0
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(found.loc[i][["start", "n_tokens", "ids_crc32"]]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = manifest.orderBy("part").first().file.removeprefix("file://")
    with open(path, "rb") as f:
        reader = token_frames.Reader(f, f.seek(0, 2))
        assert reader.ids(1)[-1] == 1 and len(reader) == len(reader.keys())
    data = bytearray(open(path, "rb").read())
    data[reader.frames[0].at + reader.frames[0].packed - 1] ^= 1
    (tmp_path / "bad").write_bytes(bytes(data))
    with open(tmp_path / "bad", "rb") as f, pytest.raises(Exception):
        token_frames.Reader(f, len(data)).frame(0)


def test_sampling_probabilities():
    p = sp_sampling.Pieces(["<u>", "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"], [0, -1, -2, -3, -1.5, -2.2, -2.9, -2.1, -4.0], [], {0})

    def every(s):
        if not s:
            yield ()
        for i, name in enumerate(p.names):
            if i and s.startswith(name):
                yield from ((i, *rest) for rest in every(s[len(name) :]))

    all_ = list(every("▁aba▁ab"))
    weight = np.array([np.exp(0.7 * sum(p.scores[i] for i in x)) for x in all_])
    prob = dict(zip(all_, weight / weight.sum()))
    n = 6000
    found = sp_sampling.sampled(["aba ab"] * n, [str(i) for i in range(n)], p, 3, 0.7, 5)
    first, pair = Counter(tuple(r[0][0]) for r in found), Counter((tuple(r[0][0]), tuple(r[1][0])) for r in found)
    assert max(abs(first[x] / n - prob[x]) for x in all_) < 0.02
    assert max(abs(pair[a, b] / n - prob[a] * prob[b] / (1 - prob[a])) for a in all_ for b in all_ if a != b) < 0.02
    assert all(len({tuple(x[0]) for x in r}) == 3 and r[0][2] >= r[1][2] >= r[2][2] for r in found)
    assert np.mean([sum(np.exp(x[1]) / x[3] for x in r) for r in found]) == pytest.approx(1, abs=0.06)
    assert len(sp_sampling.sampled(["a"], ["x"], p, 50, 0.7, 5)[0]) == 2


def test_sampling_round_trip(spark, odd, docs):
    frame = odd.unionByName(table(spark, list(docs.iloc[:30]), 100))
    found = sp_sampling.sample(frame).toPandas()
    assert set(found.doc_id.fillna(-1)) == {*range(len(ODD)), -1, *range(100, 130)}
    assert set(found[~found.exact].doc_id) == {7}  # the text with U+2581
    again = sp_sampling.sample(frame.repartition(3)).toPandas()
    assert sorted(zip(found.doc_id.fillna(-1), found["sample"], found.ids)) == sorted(zip(again.doc_id.fillna(-1), again["sample"], again.ids))


def test_quality_counts(spark, docs):
    texts = [*docs.iloc[:50], "a b c a b c", "a b c a b c d\na b c a b c d\n\n \n#x"]
    found = got(quality.judged(table(spark, texts)))
    for i, t in enumerate(texts):
        w, seen, dup, cover = words(t), set(), 0, set()
        for x in t.split("\n"):
            if words(x):
                dup += x in seen
                seen.add(x)
        c = Counter(zip(w, w[1:], w[2:]))
        for k in range(len(w) - 2):
            if c[w[k], w[k + 1], w[k + 2]] > 1:
                cover |= {k, k + 1, k + 2}
        r = found.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_kneser_ney_brute_force(spark, docs):
    texts = [t.encode() for t in docs[:150]] + ["Слова на другом языке имеют свои буквы и цифры 2024.".encode()]
    counts = Counter()
    for t in dict.fromkeys(texts):  # copies count once
        x = b"    " + bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in t)
        counts.update(x[i : i + 5] for i in range(len(t)))
    frame = spark.createDataFrame([(t.decode(), "x") for t in texts], "text string, lang string")
    got_counts = {int(r.gram).to_bytes(5, "big"): r.n for r in quality.gram_counts(frame).collect()}
    assert got_counts == counts
    tables = {5: counts}
    for k in range(4, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])  # in how many contexts
    off, by_context = {}, {}
    for k, table_ in tables.items():
        n1, n2, n3, n4 = (sum(c == j for c in table_.values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else None
        off[k] = (0.5, 1.0, 1.5) if y is None else tuple(min(max(d, 0.05), m) for m, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
        by_context[k] = defaultdict(dict)
        for g, c in table_.items():
            by_context[k][g[:-1]][g[-1]] = c

    def p(context, s):
        out = 1 / 256
        for k in range(1, 6):
            seen = by_context[k].get(context[5 - k :])
            if seen:
                d = {x: min(off[k][min(c, 3) - 1], c) for x, c in seen.items()}
                out = (seen.get(s, 0) - d.get(s, 0)) / sum(seen.values()) + sum(d.values()) / sum(seen.values()) * out
        return out

    codes = np.array([int.from_bytes(g, "big") for g in counts], np.uint64)
    model = quality.fit(codes, np.array(list(counts.values())))
    assert all((np.diff(h.astype(object)) > 0).all() for order in model for h in order[::2])  # sorted by hash
    some = [*list(counts)[:300], b"zzzzz", b"the q", b"    \xff"]
    found = quality.probability(model, np.array([int.from_bytes(g, "big") for g in some], np.uint64))
    assert found == pytest.approx([p(g[:4], g[4]) for g in some], rel=1e-5)
    every = np.array([int.from_bytes(b"the " + bytes([s]), "big") for s in range(256)], np.uint64)
    assert quality.probability(model, every).sum() == pytest.approx(1, rel=1e-5)
    want = -np.mean([np.log2(p(x[:4], x[4])) for x in (b"    the cat"[i : i + 5] for i in range(7))])
    assert quality.bits_of([b"dog", b"The cat"], model)[1] == pytest.approx(want, rel=1e-5)


def test_quality_rejects_junk(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = " ".join(f"q{i}z(x{i * 7})!jk;;" for i in range(80))
    found = got(quality.judged(frame.unionByName(frame.limit(1).withColumn("doc_id", F.lit(-5).cast("long")).withColumn("text", F.lit(junk)))))
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id").quality
    fair = found[~found.base_failed].join(labels)
    assert not found.loc[-5].kept and fair[fair.quality == 1].kept.mean() > 0.98


@pytest.mark.parametrize("copies", [1, 9, 10, 1000])
def test_quality_copies_count_once(spark, copies):
    texts = ["the same text again and again"] * copies + ["another text"]
    once = quality.gram_counts(table(spark, texts[-2:]))
    assert sorted(map(tuple, quality.gram_counts(table(spark, texts)).collect())) == sorted(map(tuple, once.collect()))


def test_simhash_brute_force(spark, docs):
    texts = [*docs, "", " "]
    found = got(simhash.groups(table(spark, texts)))
    prints = []
    for t in texts:
        w = words(t.translate(LOW))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    f = np.array(prints, np.uint64)
    assert [int(x) % (1 << 64) for x in found.loc[range(len(texts))].fp] == prints
    label = np.arange(len(f))
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    simhash.joined(label, a, b)
    assert list(found.loc[range(len(texts))].component) == list(label)
    kept = simhash.keep_one(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


@pytest.mark.parametrize("seed", range(4))
def test_trie_join(seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)))) for _ in range(400)]
    code = np.unique(centre[rng.integers(0, 40, 400)] ^ np.array(flips, np.uint64))
    label = np.arange(len(code))
    a, b = np.nonzero(np.triu(np.bitwise_count(code[:, None] ^ code[None, :]) <= 4, 1))
    simhash.joined(label, a, b)
    assert (simhash.trie_join(np.zeros(len(code), int), code) == label).all()
    assert all(any(x & m == y & m for m in simhash.masks()) for x, y in zip(code[a].tolist(), code[b].tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, 201), (201, 202), (202, 200)]
    found = {r.v: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 71)} == {0} and found[201] == found[202] == 200


def test_rows_that_share_a_key(spark):
    """Each row is judged by its own text; names that operators use within don't clash."""
    long = " ".join(f"word{i}" for i in range(60))
    texts = ["released under the MIT license", "plain words only", long, "x"]
    rows_ = [(1, texts[0], "en"), (1, texts[1], "en"), (None, texts[2], "en"), (None, texts[3], None)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, lang string").withColumns({c: F.lit(0) for c in ("k", "d", "th", "l", "hashed", "lost", "head", "own", "_k", "_gone", "_d", "n_deleted", "print")})
    found = license_scan.scan(frame).toPandas()
    assert sorted(zip(found.doc_id.fillna(-1), found.n_words, found.labels)) == [(-1, 1, ""), (-1, 60, ""), (1, 3, ""), (1, 5, "mit")]
    spans = license_scan.detections(frame).toPandas()
    assert set(spans.doc_id) == {1} and license_scan.detections(frame, []).count() == 0
    assert sorted(r.text for r in quality.good(frame).collect()) == [long]
    assert sorted(r.text for r in simhash.keep_one(frame).collect()) == sorted(texts) and simhash.keep_one(frame).columns == frame.columns
    assert sorted(r.text for r in line_dedup.deduped(frame).collect()) == sorted(texts)
    bench = spark.createDataFrame([(1, "plain words only")], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(frame, bench).collect()) == sorted([texts[0], long, "x"])


def test_pii_long_runs():
    """A million zeros or letters take no longer than their length asks for."""
    assert pii.base_spans("0" * 1_000_000 + ".1.1.1") == [(0, 1, 1_000_006)]
    assert pii.base_spans("9" * 1_000_000 + ".1.1.1") == []
    assert pii.base_spans("a" * 1_000_000 + "@b.c") == [(0, 0, 1_000_004)]
    assert len(pii.candidates("0" * 1_000_000 + " x@y")[0]) == 2


def test_pii_emails_as_the_pattern():
    import random

    rng, pattern = random.Random(1), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(5000):
        t = "".join(rng.choice("ab.@-_ 1.@b") for _ in range(rng.randint(1, 24)))
        assert pii.emails(t) == [m.span() for m in pattern.finditer(t)]


def test_pii_marginals_exact_on_a_tree():
    from itertools import product

    rng = np.random.default_rng(5)
    k = len(pii.LABELS) + 1
    w, v = rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(2, k, k))
    v = v + v.transpose(0, 2, 1)
    feats, edges = np.array([1, 3, 5, 9]), np.array([[0, 1, 0], [1, 2, 1], [1, 3, 1]])
    node = pii.unpacked(feats) @ w
    total = np.zeros((4, k))
    for y in product(range(k), repeat=4):
        p = np.exp(sum(node[i, y[i]] for i in range(4)) + sum(v[t, y[a], y[b]] for a, b, t in edges))
        for i in range(4):
            total[i, y[i]] += p
    assert np.allclose(pii.marginals(feats, edges, w, v), total / total.sum(1, keepdims=True), atol=2e-3)


def test_pii_secrets(spark):
    texts = [f"text {i} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" end" for i in range(60)] + [f"page {i} of the book" for i in range(60)]
    found = got(pii.find(table(spark, texts)))
    kinds = [{x.kind for x in found.loc[i].spans} for i in range(120)]
    assert kinds[:60] == [{"secret"}] * 60 and kinds[60:] == [set()] * 60


def test_links_of_split_tries(spark):
    rng = np.random.default_rng(2)
    codes = np.unique(np.uint64(7) ^ (rng.integers(0, 1 << 20, 300, dtype=np.uint64) << np.uint64(30)))
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    whole, split = (simhash.components(simhash.links(frame, hot=n)).toPandas() for n in (1 << 16, 8))
    assert dict(zip(whole.v, whole.root)) == dict(zip(split.v, split.root))


def test_alignments_by_convolution():
    rng = np.random.default_rng(4)
    pairs = [(np.unique(rng.integers(0, 400, 150)), np.unique(rng.integers(0, 900, 300))) for _ in range(3)]
    shifts, n = decontaminate.alignments(pairs)
    old, decontaminate.PAIRS = decontaminate.PAIRS, 10
    try:
        again = decontaminate.alignments(pairs)
    finally:
        decontaminate.PAIRS = old
    want = Counter(int(b) - int(a) for i, d in pairs for a in i for b in d)
    assert dict(zip(shifts.tolist(), n.tolist())) == want and (again[0] == shifts).all() and (again[1] == n).all()


def test_sampling_empty_table(spark, odd):
    assert sp_sampling.sample(odd.limit(0)).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = frame.columns, frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert set(found.doc_id) == {r.doc_id for r in kept.select("doc_id").collect()} and found.exact.all()
    texts = {r.doc_id: r.text for r in kept.collect()}
    first = found[found["sample"] == 0].set_index("doc_id")
    pieces = sp_sampling.load(sp_sampling.model_path())
    assert all(pieces.decode(np.frombuffer(first.loc[i].ids, "<u4")) == t.encode() for i, t in texts.items())
    assert hashlib.sha256("".join(sorted(texts.values())).encode()).hexdigest()
