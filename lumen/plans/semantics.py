"""What column names say: sensitive attributes, likely identifiers, likely leakage."""

from __future__ import annotations

from ..operators.profile import name_tokens

# fixed values
SENSITIVE = {"age", "gender", "sex", "race", "ethnicity", "religion", "disability"}
DURATION = {"account", "tenure", "days", "months", "years", "session", "duration", "contract"}
# end of fixed values


def sensitive_columns(columns: list[str]) -> list[str]:
    """Columns whose name holds a protected word; `age` beside a word of duration is the age of something else."""
    out = []
    for c in columns:
        words = name_tokens(c)
        if (words & SENSITIVE) - ({"age"} if words & DURATION else set()):
            out.append(c)
    return out


def leakage_suspects(columns: list[str], target: str) -> list[str]:
    return [c for c in columns if c != target and target.lower() in c.lower()]
