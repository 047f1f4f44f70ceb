"""Key expressions (SQL text): names compared ignoring case, and the sample order."""

from __future__ import annotations


def fold_case(text: str) -> str:
    """Equal for strings that differ only in case; a missing string equals a blank one.

    Each letter is put in upper and then in lower case, so that letters with one capital but two
    small forms agree. A letter whose capital is longer than itself stays as it is: "straße" is not
    "strasse". Such strings are rare and are folded letter by letter; the concatenation keeps the
    optimizer from dropping the inner call.
    """
    given = f"coalesce({text}, '')"
    letter = "if(length(upper(c)) = length(c), lower(concat(upper(c), '')), c)"
    by_letter = f"array_join(transform(split({given}, ''), c -> {letter}), '')"
    whole = f"lower(concat(upper({given}), ''))"
    return f"if(length(upper({given})) = length({given}), {whole}, {by_letter})"


def sample_digest(row_id: str, seed: int) -> str:
    """32 hex digits that order the rows at random, the same way for the same seed."""
    return f"md5(concat(string({row_id}), ':{int(seed)}'))"
