"""A deterministic stand-in for a text model, for driver queries and tests only.

It is no evidence of text generation: it shows that prompts reach a backend and
that replies, empty replies and failures come back as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from postflow.operators.materials import BatchFn, GenerationError, register_generator


def echo_generator() -> BatchFn:
    """`<chars>:<md5 of prompt>`; fails on prompts whose md5 starts with "00" and
    answers "" to prompts whose md5 starts with "f"."""
    def run(prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            h = hashlib.md5(p.encode("utf-8")).hexdigest()
            if h.startswith("00"):
                raise GenerationError(f"generation failed for prompt {h[:8]}")
            out.append("" if h.startswith("f") else f"{len(p)}:{h}")
        return out

    return run


def install() -> None:
    register_generator("echo", echo_generator)
