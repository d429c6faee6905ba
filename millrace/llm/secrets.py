"""Secrets by one combined automaton.

All rules are compiled into one deterministic automaton with transition arrays (subset construction, then
minimisation). It reads every byte of every text once, from right to left, and so tells where a match of which rule
begins. From the leftmost of these places the rule's own automaton reads on to the end of its longest match, and goes on
at the next place behind it: spans of a kind do not overlap, and no byte is read twice for a kind, however long a run of
candidates is. Spans too short for their kind are dropped after they have been taken, as the rules say.

Beyond the base kinds (assign, access, hex) the automaton has private-key headers (pem) and two prefixed token
formats (gh, slack). Positions are code points, ends exclusive.

Edge cases: null and empty texts have no spans; a text of any length is scanned whole, in time linear in its length;
equal rows give equal results; a null id stays null; an empty table gives an empty result; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.automaton import Automaton, compile_rules, longest, starts
from millrace.llm.wordbytes import steps, text_bytes

_VALUE = "[A-Za-z0-9+/_.=-]"
_HEAD = r"""["']?\x20*[:=]\x20*["']?"""
_NAME = "(password|passwd|secret|token|api_?key)"
#: kind, head in either case, rest of the pattern, least characters of the rest (of the match where the head is empty).
RULES: list[tuple[str, str, str, int]] = [
    ("assign", _NAME, f"{_HEAD}{_VALUE}+", 12),
    ("access", "", "AKIA[A-Z0-9]+", 18),
    ("hex", "", "[0-9a-f]+", 16),
    ("pem", "", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("gh", "", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", "", "xox[abpr]-[0-9A-Za-z-]+", 20),
]
BASE = 3


def _either_case(pattern: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in pattern)


@lru_cache(maxsize=1)
def scanner() -> Automaton:
    """The automaton of all rules. Runs of hex digits below the least length are left out here: no other match can begin inside a run."""
    there = [(_either_case(_NAME) + _HEAD + _VALUE, False), ("AKIA[A-Z0-9]", False), ("[0-9a-f]{16}", False), *((head + rest, False) for _, head, rest, _ in RULES[BASE:])]
    return compile_rules(there, anywhere=True, backward=True)


@lru_cache(maxsize=1)
def _ends() -> list[tuple[Automaton, tuple[list[int], list[int], list[int]]]]:
    """Each rule's own automaton, for the ends of matches."""
    made = [compile_rules([(_either_case(head) + rest, False)], anywhere=False) for _, head, rest, _ in RULES]
    return [(a, (a.classes.tolist(), a.table.tolist(), a.accepts.tolist())) for a in made]


def spans(text: bytes, at: np.ndarray, rules: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, rule) of all spans, in bytes, by start and rule. at, rules: where matches begin, and of which rules (bits)."""
    found: list[tuple[int, int, int]] = []
    for k, (automaton, lists) in enumerate(_ends()):
        places = at[(rules >> k) & 1 == 1]
        i = 0
        while i < len(places):
            start = int(places[i])
            end = longest(automaton, lists, text, start)
            if _long_enough(text, start, end, k):
                found.append((start, end, k))
            i = int(np.searchsorted(places, end))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _long_enough(text: bytes, start: int, end: int, rule: int) -> bool:
    kind, head, _, least = RULES[rule]
    if not head:
        return end - start >= least
    # The value is what follows the first separator, white space and quote behind the name.
    i = start
    while text[i] not in b":=":
        i += 1
    i += 1
    while text[i] == 0x20:
        i += 1
    if text[i] in b"\"'":
        i += 1
    return end - i >= least


def _row(text: bytes, at: np.ndarray, rules: np.ndarray) -> tuple[int, int, int, str, str]:
    found = spans(text, at, rules)
    if found:
        # Code points before each place: bytes that do not continue a character.
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        bounds = sorted({0, *(x for s, e, _ in found for x in (s, e))})
        chars = accumulate(int(np.count_nonzero(lead[a:b])) for a, b in pairwise(bounds))
        before = dict(zip(bounds, [0, *chars]))
        found = [(before[s], before[e], k) for s, e, k in found]
    joined = lambda rows: ",".join(f"{RULES[k][0]}:{s}:{e}" for s, e, k in rows)
    base = joined(x for x in found if x[2] < BASE)
    counts = [sum(k == j for _, _, k in found) for j in range(BASE)]
    return *counts, hashlib.sha256(base.encode()).hexdigest(), joined(found)


_NONE = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def _scanned() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in steps(offsets):
                cut = offsets[a : b + 1]
                at, rules = starts(scanner(), raw, cut)
                limits = np.searchsorted(at, cut)
                rows = [_row(raw[s:e].tobytes(), at[i:j] - s, rules[i:j]) if i < j else _NONE for s, e, i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), limits[:-1].tolist(), limits[1:].tolist())]
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return run


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned(), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _oracle() -> str:
    """Matches and the texts between them give the places: a match starts behind all that stands before it."""
    kinds = []
    for k, (kind, head, rest, least) in enumerate(RULES):
        pattern = (_either_case(head) + rest).replace("'", "''")
        # A value is what is left behind the name, the separator and a quote.
        value = f"regexp_replace(m[i], '^{(_either_case(head) + _HEAD).replace(chr(39), chr(39) * 2)}', '')" if head else "m[i]"
        kinds.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, m[i] AS hit, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS begins, length({value}) >= {least} AS good "
            f"FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d))"
        )
    text = "kind || ':' || begins || ':' || (begins + length(hit))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS ({' UNION ALL '.join(kinds)}), g AS (SELECT * FROM h WHERE good)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256(coalesce(string_agg({text}, ',' ORDER BY begins, k) FILTER (k < {BASE}), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY begins, k), '') AS spans
FROM d LEFT JOIN g USING (doc_id) GROUP BY doc_id"""


ORACLE = _oracle()
