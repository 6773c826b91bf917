import hashlib
import random
import zlib

import pytest

from proofmill.llm.turns import NEXT, cheapest_audit, damaged, repair_conversations, repaired_sha256, turn_code

WHITE = " \t\n\x0b\x0c\r"


def every_audit(codes):
    """The cheapest (cost, audit) by trying all edits."""
    out = []

    def go(i, state, cost, audit, inserted):
        if i == len(codes) and state in "0a":
            out.append((cost, audit))
        if inserted < len(codes) + 2:
            go(i, NEXT[state], cost + 3, audit + "I", inserted + 1)
        if i < len(codes):
            go(i + 1, state, cost + 4, audit + "D", inserted)
            if codes[i] != 4:
                kind, extra = "sua?"[codes[i] & 3], 3 if codes[i] & 8 else 0
                if kind == NEXT[state] or kind == "s" and state == "0":
                    go(i + 1, kind, cost + extra, audit + "K", inserted)
                go(i + 1, NEXT[state], cost + extra + 3, audit + "R", inserted)

    go(0, "0", 0, "", 0)
    return min(out)


def by_states(codes):
    """The same in one pass over the four grammar states."""
    best = {"0": (0, "")}

    def inserted():
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                option = (cost + 3, audit + "I")
                best[NEXT[state]] = min(best.get(NEXT[state], option), option)

    for code in codes:
        inserted()
        new = {}
        for state, (cost, audit) in best.items():
            kind, extra = "sua?"[code & 3], 3 if code & 8 else 0
            options = [(state, (cost + 4, audit + "D"))]
            if code != 4:
                if kind == "s" and state == "0":
                    options.append(("s", (cost + extra, audit + "K")))
                same = kind == NEXT[state]
                options.append((NEXT[state], (cost + extra + 3 * (not same), audit + ("K" if same else "R"))))
            for s, o in options:
                new[s] = min(new.get(s, o), o)
        best = new
    inserted()
    return min(best[s] for s in "0a" if s in best)


def some_codes(r, n, noise):
    return bytes(r.choice([0, 1, 2, 3, 4, 8, 9, 10, 11]) if r.random() < noise else 1 + i % 2 for i in range(n))


def test_against_every_audit():
    r = random.Random(1)
    for _ in range(150):
        codes = some_codes(r, r.randint(0, 5), r.choice([0.3, 1]))
        assert every_audit(codes) == by_states(codes) == cheapest_audit(codes), codes


def test_sections_give_what_one_table_gives():
    r = random.Random(2)
    for _ in range(200):
        codes = some_codes(r, r.randint(1, 90), r.choice([0.1, 0.5, 1]))
        want = by_states(codes)
        assert cheapest_audit(codes) == want
        assert cheapest_audit(codes, section=r.randint(1, 20)) == want
    codes = some_codes(r, 5000, 0.2)
    assert cheapest_audit(codes) == by_states(codes)


def plain(rows):
    """What the query should return for (conv, turn, role, text) rows, by plain loops."""
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        turns = {t for t, _, _ in kept if t is not None}
        seen, codes, n = set(), [], [0, 0, 0]
        for _, role, text in kept:
            body = text.strip(WHITE)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            codes.append(turn_code(role[:1], fault < 2, fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = by_states(codes)
        lines, at, last = [], 0, ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else kept[at][1:]
            at += letter != "I"
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[:1]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk():
    r = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "so what", " \n", None, "¿Qué?", "end. \t", "Yes."]
    rows = [(c, t, r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"text {c} {t}.") for c in range(60) for t in range(r.randint(1, 12))]
    rows += [(70, None, "user", "first?"), (70, None, "user", "first?"), (70, 3, "user", "first?"), (70, 9, "assistant", "x" * 300000 + "."), (None, 1, "user", "lost."), (None, None, None, None), (71, 5, "user", "same."), (71, 5, "user", "same."), (71, 5, "assistant", "other.")]
    rows += [(72, t, "user" if t % 2 else "assistant", f"line {t % 40}" + "." * (t % 7 > 0)) for t in range(9000)]
    return rows


def test_query_against_plain_loops(spark, talk):
    extra = ("x", 1, 2.0, "y")
    docs = spark.createDataFrame([(*row, *extra) for row in talk], "conv_id long, turn long, role string, text string, conv string, copies int, cost double, audit string").repartition(3)
    got = repair_conversations(damaged(docs), key="conv").collect()
    want = plain(talk)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv], (r.conv, r, want[r.conv])


def test_a_conversation_without_turns_stays(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(dropped, 0, "user", "gone.")], "conv_id long, turn long, role string, text string")
    (r,) = repair_conversations(damaged(docs), key="conv").collect()
    assert tuple(r) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_conversations(damaged(docs.limit(0)), key="conv").count() == 0


def test_text_keys_and_plain_rows(spark):
    docs = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "user", "Hello?"), ("a", 1, "assistant", "Yes.")], "id string, turn int, role string, text string")
    (r,) = repair_conversations(docs, key="id").collect()
    # rows of one turn go by role: user, assistant, user, and the last is deleted or answered
    assert (r.id, r.cost, r.audit, r.illegal) == ("a", 3, "KKKI", 0)
    assert r.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes.\nuser:Hello?\nassistant:").hexdigest() == repaired_sha256("KKKI", [("user", "Hi."), ("assistant", "Yes."), ("user", "Hello?")])
