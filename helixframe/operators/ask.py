"""Natural language to filter expressions, by a translator that the caller brings; nothing here uses a network."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from helixframe.errors import ExpressionError, VariantError
from helixframe.plans.expression import parse_expr
from helixframe.sources.header import Header

#: Fixed value: below this confidence an unattended run needs leave.
LEAST_CONFIDENCE = 0.51
MOCK = "HELIXFRAME_MOCK_TRANSLATION"
SHOWN_CONTIGS = 12


@dataclass(frozen=True)
class Translation:
    expression: str
    reasoning: str = ""
    confidence: float = 0.0
    caveats: list[str] = field(default_factory=list)


def prompt(question: str, header: Header) -> str:
    """What a translator needs to know: the language, the file's fields and its contigs."""
    describe = lambda kind, lines: [f"{kind}/{k}: {v.type}, Number={v.number}. {v.values.get('Description', '')}" for k, v in lines.items()]
    contigs = list(header.contigs)
    shown = ", ".join(contigs[:SHOWN_CONTIGS]) + (f", ... ({len(contigs)} in all)" if len(contigs) > SHOWN_CONTIGS else "")
    rules = [
        "Write one filter expression for the question below.",
        "Fields: CHROM, POS, QUAL, FILTER, INFO/<key>, FORMAT/<key> (first sample, as text if it has several values).",
        "Operators: < <= > >= == != ~ (contains) !~; && || ! and parentheses. Texts in single quotes; numbers without exponent.",
        "A field alone asks whether it is there. A comparison with a missing value is false. A list on the left matches by any of its values.",
        'Answer with JSON: {"expression": "...", "reasoning": "...", "confidence": 0.0 to 1.0, "caveats": []}',
    ]
    return "\n".join([*rules, *describe("INFO", header.infos), *describe("FORMAT", header.formats), f"Contigs: {shown}", f"Question: {question}"])


def extract_json(text: str) -> str:
    """The JSON part of an answer: a fenced block, else from the first to the last brace, else all of it."""
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL):
        return m[1].strip()
    if "{" in text and "}" in text:
        return text[text.index("{") : text.rindex("}") + 1]
    return text.strip()


def read_answer(text: str) -> Translation:
    try:
        got = json.loads(extract_json(text))
        found = Translation(got["expression"], got.get("reasoning", ""), float(got.get("confidence", 0.0)), list(got.get("caveats", [])))
    except (ValueError, KeyError, TypeError) as e:
        raise VariantError(f"the translator's answer is not as asked: {e}") from e
    parse_expr(found.expression)
    return found


def translate(question: str, header: Header, translator: Callable[[str], str] | None = None) -> Translation:
    """The translator's expression; it gets one more try with the parser's message.  A mock in the environment comes first."""
    if mock := os.environ.get(MOCK):
        return read_answer(mock)
    if translator is None:
        raise VariantError("no translator is given")
    asked = prompt(question, header)
    try:
        return read_answer(translator(asked))
    except (ExpressionError, VariantError) as e:
        return read_answer(translator(f"{asked}\nYour last answer failed: {e}\nCorrect it."))


def accepted(found: Translation, unattended: bool = False, accept_low_confidence: bool = False, confirm: Callable[[Translation], bool | str] | None = None) -> str:
    """The expression, if it may be used: confirmed, or unattended and sure enough.  ``confirm`` may give another text, which must parse."""
    if unattended:
        if found.confidence < LEAST_CONFIDENCE and not accept_low_confidence:
            raise VariantError(f"confidence {found.confidence:.2f} is below {LEAST_CONFIDENCE}; accept it with accept_low_confidence")
        return found.expression
    answer = confirm(found) if confirm else False
    if isinstance(answer, str):
        parse_expr(answer)
        return answer
    if not answer:
        raise VariantError("the expression was not confirmed")
    return found.expression


#: Fixed value: share of the questions that an evaluation must answer as expected.
PASS_SHARE = 0.85


def evaluate(cases: Iterable[tuple[str, str]], header: Header, translator: Callable[[str], str] | None = None) -> tuple[float, list[tuple[str, str, str]]]:
    """(share of the (question, expected expression) cases answered alike but for spaces, the others with what came instead)."""
    wrong, n = [], 0
    for question, want in cases:
        n += 1
        try:
            got = translate(question, header, translator).expression
        except VariantError as e:
            got = str(e)
        if "".join(got.split()) != "".join(want.split()):
            wrong.append((question, want, got))
    return (1 - len(wrong) / n if n else 1.0), wrong
