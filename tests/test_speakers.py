"""Whose words a claim is, against a plain version that scans each source."""

import random
import re

from strataloom.operators.verification import PLAIN_WORDS, SAYING, spoken

STOP = {"The", "This", "That", "In", "On", "At", "And", "But", "For", "Of"}
SAYS = rf"(?<!\w)(?:{'|'.join(SAYING)})(?!\w)"


def names(text):
    out, run, end = [], [], None
    for m in [*re.finditer(r"[^\W\d_]+", text), None]:
        w = m and m[0]
        capital = m is not None and len(w) > 1 and w[0].isupper() and (w[1:].islower() or w.isupper()) and w not in STOP
        if not (capital and end is not None and not text[end : m.start()].strip()):
            if 2 <= len(run) <= 3 and " ".join(run).lower() not in out:
                out.append(" ".join(run).lower())
            run = []
        if capital:
            run.append(w)
        end = m and m.end()
    return out


def at(what, low):
    return [m.start() for m in re.finditer(rf"(?<!\w){re.escape(what)}(?!\w)", low)]


def claims(text):
    return dict.fromkeys(t.strip(".,/_-") for t in re.findall(r"[^\W_]*\d[\w./,-]*", text.lower()))


def owner(source, person, where):
    low = source.lower()
    speaking = {person} | {n for n in names(source) if any(re.search(SAYS, low[a + len(n) : a + len(n) + 200 + 12]) and re.search(SAYS, low[a + len(n) :]).start() < 200 for a in at(n, low))}
    before = [(a, n) for n in speaking for a in at(n, low) if a < where]
    return max(before)[1] if before else None


def plain(sentences, sources):
    out = []
    for i, n, text in sentences:
        low = text.lower()
        if not re.search(SAYS, low):
            continue
        for person in names(text):
            holding = [s for j, _, s in sources if j == i and at(person, s.lower())]
            places = {c: [owner(s, person, a) for s in holding for a in at(c, s.lower())] for c in claims(text)}
            given = sorted(c for c, own in places.items() if own and all(o not in (None, person) for o in own))
            if not given:
                w = [x for x in re.findall(r"[^\W\d_]+", low) if len(x) > 2 and x not in PLAIN_WORDS and x not in person.split()]
                stem = lambda x: x[: max(3, len(x) - 3)]
                found = {}
                for k, (a, b) in enumerate(zip(w, w[1:], strict=False)):
                    found.setdefault(f"{a} {b}", (k, [owner(s, person, m.start()) for s in holding for m in re.finditer(rf"(?<!\w)(?=({stem(a)}\w*\s+{stem(b)}\w*))", s.lower())]))
                mine = any(person in own for own in places.values()) or any(person in own for _, own in found.values())
                given = [] if mine else [p for p, (_, own) in sorted(found.items(), key=lambda x: x[1][0]) if any(o not in (None, person) for o in own)]
            if given:
                out.append((i, n, person, given))
                break
    return sorted(out)


def test_spoken_equals_plain_version(spark):
    rng = random.Random(12)
    people = ["Anna Berg", "Carl Dahl", "EVA LUND HOLM", "Otto Frey"]
    facts = ["it cost 500 euros", "half days were worked", "the meeting began at 13:00", "nobody paid 12/4", "wet floors caused falls", "they left on 3.4.2020"]
    verb = lambda: rng.choice([*SAYING[:4], "saw", "met"])
    sources = [(i, k, " ".join(f"{rng.choice([*people, 'The man', 'One Two Three Four'])} {verb()} {rng.choice(facts)}." for _ in range(rng.randrange(1, 6)))) for i in range(150) for k in range(rng.randrange(3))]
    sentences = [(i, n, f"{rng.choice(['', 'In May '])}{rng.choice(people)} {verb()} {rng.choice(facts).replace('worked', 'working')}{rng.choice(['', ' and Otto Frey knew'])}.") for i in range(150) for n in range(3)]
    sources += [(200, 1, "Nothing. 500 euros. Anna Berg said no. " + "x " * 150 + "Carl Dahl said 700."), (201, 1, None), (202, 1, "")]
    sentences += [(200, 0, "Anna Berg said it was 500."), (200, 1, "Anna Berg said it was 700."), (201, 0, "Anna Berg said 1."), (202, 0, None), (203, 0, "Anna Berg said 1.")]
    got = spoken(spark.createDataFrame(sentences, "id long, n int, text string"), spark.createDataFrame(sources, "id long, k int, text string")).collect()
    want = plain([s for s in sentences if s[2]], [s for s in sources if s[2]])
    own = sorted((r.id, r.n, r.person, sorted(r.given) if any(c.isdigit() for c in r.given[0]) else r.given) for r in got)
    assert [x for x in own if x not in want] == [x for x in want if x not in own] == [] and len(want) > 10
