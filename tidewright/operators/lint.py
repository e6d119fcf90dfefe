"""Warnings about candidates whose parameters the data's spacing cannot tell apart."""

from __future__ import annotations

from dataclasses import dataclass

from tidewright.functions.families import DEFAULTS, FAMILIES, Layout, labels

# Steps per time scale beyond which a process is white in double precision, and the ratio of pinned scales that overlap.
WHITE_STEPS, OVERLAP = 18.021826694558577, 1.5


@dataclass(frozen=True)
class Finding:
    rule: str
    terms: tuple[str, ...]
    message: str


def lint(expression: str, dt: float, pinned: dict[str, float] | None = None) -> list[Finding]:
    """Findings for a candidate at a median step; ``pinned`` fixes time scales by term label."""
    pinned = pinned or {}
    if not expression.strip():
        return [Finding("no_noise_terms", (), "the candidate has no noise term")]
    out, checked = [], []
    for text in (x.strip() for x in expression.split("+")):
        kind = text.partition("(")[0].strip()
        if kind not in FAMILIES:
            out.append(Finding("not_lintable", (text,), f"{text} is no known family, so it was not checked"))
        elif FAMILIES[kind].dim and "rho" not in FAMILIES[kind].params:
            out.append(Finding("not_lintable", (text,), f"{text} has a state but no time scale that can be read, so it was not checked"))
        else:
            checked.append(text)
    if not checked:
        return out
    layout = Layout.of(" + ".join(checked))
    pinned = {term: value for (term, name), value in zip(layout.names, layout.fixed, strict=True) if name == "rho" and value is not None} | pinned
    named = list(zip(labels(layout.kinds), layout.kinds, strict=True))
    white = [n for n, k in named if not FAMILIES[k].dim]
    stateful = [(n, k, pinned.get(n)) for n, k in named if FAMILIES[k].dim]
    if len(white) > 1:
        out.append(Finding("nugget_collapse", tuple(white), f"only the sum of {', '.join(white)} can be told"))
    for n, _, rho in stateful:
        if (rho if rho is not None else DEFAULTS["rho"]) < dt / WHITE_STEPS:
            out.append(Finding("white_collapse", (n, *white), f"{n} is white at this spacing, as {white[0]} is") if white else Finding("timescale_unidentified", (n,), f"the time scale of {n} is below what this spacing can tell"))
    for i, (n, k, rho) in enumerate(stateful):
        for m, other, scale in stateful[i + 1 :]:
            if k != other:
                continue
            if rho is None or scale is None:
                out.append(Finding("same_kind_free_timescales", (n, m), f"{n} and {m} can change places"))
            elif max(rho, scale) < OVERLAP * min(rho, scale):
                out.append(Finding("same_kind_pinned_overlap", (n, m), f"the time scales of {n} and {m} are too close"))
    return out
