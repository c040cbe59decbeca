"""Every operator's query against a plain Python version of its contract, on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from compare import DATA

from episode_mart.llm.queries import QUERIES

SF = f"{DATA}/sf0.01"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return rows("documents")


def result(spark, name, key="doc_id"):
    return {r[key]: r.asDict() for r in QUERIES[name](spark, SF).collect()}


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_op1_is_right_on_held_out_documents(spark, docs):
    got = result(spark, "op1_language_id")
    assert len(got) == len(docs)
    out = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in out} == {k for k, r in got.items() if r["held_out"]}
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op2_base_phrases(spark, docs):
    got = result(spark, "op2_license_scan")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for d in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(d["text"] or ""))
        at = [(i, label) for phrase, label in phrases.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        places = [i for i, _ in at]
        assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at}))
        assert {label for _, label in at} <= set(r["labels"].split(","))


def base_secrets(text):
    kinds = [
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, good) in enumerate(kinds)
            for m in re.finditer(p, text) if good(m)]


def test_op4_base_spans(spark, docs):
    got = result(spark, "op4_secret_scan")
    seen = 0
    for d in docs:
        found = sorted(base_secrets(d["text"] or ""))
        r, counts = got[d["doc_id"]], Counter(n for _, n, _ in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts[0], counts[1], counts[2])
        assert r["base_sha256"] == sha(",".join(s for _, _, s in found))
        spans = r["spans"].split(",")
        assert {s for _, _, s in found} <= set(spans)
        assert [s for s in spans if not s.startswith("entropy") and s] == [s for _, _, s in found]
        seen += len(found)
    assert seen > 5


def test_op9_reads_back(spark):
    got = result(spark, "op9_chat_format", "conv_id")
    says = "</s>[INST] ok [/INST]"
    table = rows("conversations") + [{"conv_id": -7, "turn": 0, "role": "user", "text": says},
                                     {"conv_id": -7, "turn": 1, "role": "assistant", "text": says}]
    by = defaultdict(list)
    for r in sorted(table, key=lambda r: (r["conv_id"], r["turn"])):
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    assert set(by) == set(got)
    for k, turns in by.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = got[k]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))
        assert r["formatted_chars"] >= sum(len(role) + len(t) for role, t in turns)


def repeated(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)})


def test_op10_counts(spark, docs):
    got = result(spark, "op10_quality_rules")
    for d in docs:
        text, r = d["text"] or "", got[d["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        n, repeats = len(words), repeated(words)
        assert r["n_words"] == n and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == repeats
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_op10_tells_labelled_quality(spark):
    got = result(spark, "op10_quality_rules")
    labels = [r for r in rows("labels") if not got[r["doc_id"]]["base_failed"]]
    assert sum(got[r["doc_id"]]["kept"] == (r["quality"] == 1) for r in labels) >= 0.9 * len(labels)


def test_op7_finds_what_alignment_finds(spark, docs):
    """Every run of 13 equal words is found, and all that is found agrees as the check asks."""
    items = {r["item_id"]: re.findall(r"[^\W_]+", (r["text"] or "").lower()) for r in rows("benchmark")}
    eights = defaultdict(set)
    for k, words in items.items():
        for i in range(len(words) - 12):
            eights[tuple(words[i:i + 13])].add(k)
    expected = set()
    for d in docs:
        words = re.findall(r"[^\W_]+", (d["text"] or "").lower())
        for i in range(len(words) - 12):
            expected |= {(d["doc_id"], k) for k in eights.get(tuple(words[i:i + 13]), ())}
    got = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op7_decontaminate"](spark, SF).collect()}
    assert expected and expected <= set(got)
    for (doc, item), r in got.items():  # each has a place where 13 aligned words of 18 agree
        words = re.findall(r"[^\W_]+", next(d["text"] for d in docs if d["doc_id"] == doc).lower())
        other = items[item]
        best = max(sum(a == b for a, b in zip(words[i:i + 18], other[j:j + 18], strict=False))
                   for i in range(len(words)) for j in range(len(other)))
        assert best >= min(13, -(-len(other) * 4 // 5))


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9)
    return total % 10 == 0


def base_personal(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, good in kinds for m in re.finditer(p, text) if good(m)]


def test_op8_base_spans(spark, docs):
    got = result(spark, "op8_personal_data")
    seen = Counter()
    for d in docs:
        found = base_personal(d["text"] or "")
        r, counts = got[d["doc_id"]], Counter(s.split(":")[0] for s in found)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            counts[k] for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == sha(",".join(found))
        assert set(found) <= set(r["spans"].split(",")) or not found
        seen.update(counts)
    assert min(seen[k] for k in ("email", "ip", "card", "phone")) > 0
