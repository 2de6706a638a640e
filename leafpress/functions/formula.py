"""Formulas of the office math vocabulary as LaTeX or MathML, and their tokens; an Arrow function, since trees recurse."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

# Signs and names.
GREEK = {chr(0x3B1 + i): f"\\{n}" for i, n in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi o pi rho varsigma sigma tau upsilon phi chi psi omega".split())}
SIGNS = GREEK | {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∞": "\\infty", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "±": "\\pm", "×": "\\times", "÷": "\\div", "→": "\\to", "∂": "\\partial", "∈": "\\in", "⋅": "\\cdot"}
ACCENTS = {"̂": "hat", "̃": "tilde", "̄": "bar", "⃗": "vec", "̇": "dot"}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _local(c) == name), None)


def _val(e: ET.Element | None, prop: str, default: str) -> str:
    p = _child(e, prop) if e is not None else None
    return default if p is None else next((v for k, v in p.attrib.items() if k.rpartition("}")[2] == "val"), default)


def tokens(e: ET.Element) -> list[str]:
    """Texts of a formula in order."""
    return [c.text or "" for c in e.iter() if _local(c) == "t"]


def latex(e: ET.Element | None) -> str:
    if e is None:
        return ""
    kind, part = _local(e), lambda name: latex(_child(e, name))
    if kind == "t":
        return "".join(SIGNS[c] + " " if c in SIGNS else "\\" + c if c in "#$%&_{}" else c for c in e.text or "")
    if kind == "f":
        return f"\\frac{{{part('num')}}}{{{part('den')}}}"
    if kind == "sSup":
        return f"{{{part('e')}}}^{{{part('sup')}}}"
    if kind == "sSub":
        return f"{{{part('e')}}}_{{{part('sub')}}}"
    if kind == "sSubSup":
        return f"{{{part('e')}}}_{{{part('sub')}}}^{{{part('sup')}}}"
    if kind == "rad":
        degree = part("deg")
        return f"\\sqrt[{degree}]{{{part('e')}}}" if degree else f"\\sqrt{{{part('e')}}}"
    if kind == "nary":
        sign = _val(_child(e, "naryPr"), "chr", "∫")
        limits = "".join(f"{m}{{{t}}}" for m, t in (("_", part("sub")), ("^", part("sup"))) if t)
        return f"{SIGNS.get(sign, sign)}{limits}{{{part('e')}}}"
    if kind == "d":
        pr = _child(e, "dPr")
        inner = _val(pr, "sepChr", "|").join(latex(c) for c in e if _local(c) == "e")
        return f"\\left{_val(pr, 'begChr', '(') or '.'}{inner}\\right{_val(pr, 'endChr', ')') or '.'}"
    if kind == "func":
        return f"\\operatorname{{{part('fName')}}}{{{part('e')}}}"
    if kind == "m":
        return "\\begin{matrix}" + " \\\\ ".join(" & ".join(latex(c) for c in row if _local(c) == "e") for row in e if _local(row) == "mr") + "\\end{matrix}"
    if kind == "acc":
        return f"\\{ACCENTS.get(_val(_child(e, 'accPr'), 'chr', chr(0x302)), 'hat')}{{{part('e')}}}"
    if kind == "bar":
        return f"\\overline{{{part('e')}}}"
    if kind.endswith("Pr"):
        return ""
    return "".join(latex(c) for c in e)


def mathml(e: ET.Element | None) -> str:
    from xml.sax.saxutils import escape

    if e is None:
        return "<mrow/>"
    kind, part = _local(e), lambda name: mathml(_child(e, name))
    if kind == "t":
        text = escape(e.text or "")
        return f"<mn>{text}</mn>" if text.replace(".", "", 1).isdigit() else f"<mi>{text}</mi>" if text.isalpha() else f"<mo>{text}</mo>"
    shapes = {"f": ("mfrac", "num", "den"), "sSup": ("msup", "e", "sup"), "sSub": ("msub", "e", "sub"), "sSubSup": ("msubsup", "e", "sub", "sup")}
    if kind in shapes:
        tag, *names = shapes[kind]
        return f"<{tag}>{''.join(part(n) for n in names)}</{tag}>"
    if kind == "rad":
        return f"<mroot>{part('e')}{part('deg')}</mroot>" if latex(_child(e, "deg")) else f"<msqrt>{part('e')}</msqrt>"
    if kind == "nary":
        return f"<munderover><mo>{escape(_val(_child(e, 'naryPr'), 'chr', '∫'))}</mo>{part('sub')}{part('sup')}</munderover>{part('e')}"
    if kind == "d":
        pr = _child(e, "dPr")
        return f"<mrow><mo>{escape(_val(pr, 'begChr', '('))}</mo>{''.join(mathml(c) for c in e if _local(c) == 'e')}<mo>{escape(_val(pr, 'endChr', ')'))}</mo></mrow>"
    if kind == "m":
        return "<mtable>" + "".join("<mtr>" + "".join(f"<mtd>{mathml(c)}</mtd>" for c in row if _local(c) == "e") + "</mtr>" for row in e if _local(row) == "mr") + "</mtable>"
    if kind.endswith("Pr"):
        return ""
    return "<mrow>" + "".join(mathml(c) for c in e) + "</mrow>"


def _each(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for x in s:
                try:
                    out.append(None if x is None else f(ET.fromstring(x)))
                except ET.ParseError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def to_latex(column):
    """LaTeX of a formula's XML; null for null and for XML that isn't well-formed."""
    return F.pandas_udf(_each(lambda e: latex(e).strip()), "string")(column)


def to_mathml(column):
    return F.pandas_udf(_each(lambda e: f"<math>{mathml(e)}</math>"), "string")(column)


def math_tokens(column):
    return F.pandas_udf(_each(tokens), "array<string>")(column)
