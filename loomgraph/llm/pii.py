"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, digits and
identifier cues; local parsers expand each anchor to the boundaries of an email, address, number or
account and validate it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in the order of their spans, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "email_words", "iban", "ssn", "account")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\x00-\x20<>\"'`{}|\\^]+")
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+|\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?[A-Za-z0-9-]+)+"
_AT_WORDS = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?(" + _DOMAIN + ")", re.IGNORECASE)
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_SEPARATOR = r"[\x20:#=.]*(?:(?:no|nr|number|is)\b[\x20:#=.]*)?"
_IBAN = re.compile(_SEPARATOR + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(_SEPARATOR + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(_SEPARATOR + r"([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,19})(?![A-Za-z0-9])")

_SCHEMES = ("http://", "https://", "ftp://", "mailto:")
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account",
         "passport": "account", "customer id": "account", "member id": "account", "licence": "account",
         "license no": "account"}
_CHUNK = 4096
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    packed = text.replace(" ", "")
    if not 15 <= len(packed) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", *_DIGITS):
        found.add_word(word, word)
    for word in _SCHEMES:
        found.add_word(word, "scheme")
    for word in ("(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]"):
        found.add_word(word, "at")
    for word, kind in _CUES.items():
        found.add_word(word, kind)
    found.make_automaton()
    return found


class Finder:
    """Finds the spans of one text: (order of the kind, start, end) in code points."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        done = dict.fromkeys(("email", "ip", "card", "phone", "url", "email_words", "iban", "ssn", "account"), 0)

        def add(kind: str, start: int, end: int, ok: bool = True) -> None:
            """A match, valid or not, uses its characters up for its kind."""
            done[kind] = end
            if ok:
                out.append((KINDS.index(kind), start, end))

        lowered = text.lower()
        if len(lowered) != len(text):  # a few capitals become two characters
            lowered = text.translate(_ASCII_LOWER)
        for last, what in self.anchors.iter(lowered):
            if what == "@":
                self._email(text, last, done, add)
            elif what == "+":
                if last >= done["phone"] and (m := _PHONE.match(text, last)):
                    add("phone", last, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15)
            elif what in _DIGITS:
                self._number(text, last, done, add)
            elif what == "scheme":
                self._url(text, lowered, last, done, add)
            elif what == "at":
                self._email_in_words(text, last, done, add)
            else:
                self._account(text, last, what, done, add)
        return sorted(out)

    @staticmethod
    def _email(text: str, at: int, done: dict, add) -> None:
        start, floor = at, done["email"]
        while start > floor and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            add("email", start, m.end())

    @staticmethod
    def _number(text: str, at: int, done: dict, add) -> None:
        """A digit that starts a number: neither kind has used it up."""
        if at >= done["ip"]:
            if m := _IP.match(text, at):
                add("ip", at, m.end(), all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split(".")))
            else:  # no later digit of this run can start a match that this one doesn't: the run is the first part
                end = at + 1
                while end < len(text) and text[end] in _DIGITS:
                    end += 1
                done["ip"] = end
        if at >= done["card"]:
            if m := _CARD.match(text, at):
                digits = [c for c in m[0] if c in _DIGITS]
                add("card", at, m.end(), 13 <= len(digits) <= 19 and luhn("".join(digits)))
            else:
                done["card"] = at + 1

    @staticmethod
    def _url(text: str, lowered: str, last: int, done: dict, add) -> None:
        start = max(lowered.rfind(s, max(0, last + 1 - len(s)), last + 1) for s in _SCHEMES)
        if start < done["url"] or not (m := _URL_REST.match(text, last + 1)):
            return
        end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
        if end > last + 1:
            add("url", start, end)

    @staticmethod
    def _email_in_words(text: str, last: int, done: dict, add) -> None:
        """name (at) host (dot) tld"""
        sign = max(text.rfind(c, max(0, last - 6), last + 1) for c in "([{<")
        before = sign - 1 if sign and text[sign - 1].isspace() else sign
        m = _AT_WORDS.match(text, before)
        start = before
        while start > done["email_words"] and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if m and start < before:
            add("email_words", start, m.end())

    @staticmethod
    def _account(text: str, last: int, kind: str, done: dict, add) -> None:
        pattern = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[kind]
        m = pattern.match(text, last + 1)
        if m and m.start(1) >= done[kind]:
            add(kind, m.start(1), m.end(1), kind != "iban" or iban_ok(m[1]))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``pii``: array of {kind, start, end} in code points, end exclusive, by kind, then start.

    Base kinds, leftmost and not overlapping per kind, failing matches dropped without a retry: email, ip
    (parts at most 255), card (13 to 19 digits that pass the Luhn check), phone (+ and 9 to 15 digits).
    Added: url (after a scheme), email_words ("name (at) host (dot) org"), iban (checked by its remainder),
    ssn and account numbers, each only after a cue.

    Null and empty texts have none. Each row is looked at alone and whole, so ties and repeated rows need
    no rule, and nothing is shuffled. A column named ``pii`` is replaced; an empty table stays empty.
    """
    plain = docs.drop("pii")
    names = plain.columns
    schema = plain.selectExpr("*", "cast(null as array<struct<kind:string,start:int,end:int>>) as pii").schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in finder.spans(text)] if text else []
                for text in batch.column(names.index(text_col)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "pii"])

    return plain.mapInArrow(run, schema)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""

    def step(state: Column, s: Column) -> Column:
        after = s["start"] >= state["at"]
        piece = F.concat(
            state["out"],
            F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))),
            F.when(after, F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(""),
        )
        return F.struct(piece.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(
        by_start,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))),
    )


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pii = F.col("pii")
    count = lambda kind: F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return find_pii(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.filter(pii, lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        joined(pii).alias("spans"),
    )
