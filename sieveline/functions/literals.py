"""Small driver-side values as SQL literals (one parse instead of one call per element)."""


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(pattern: str) -> str:
    """A regular expression as a SQL literal; patterns hold no quote character."""
    return f"r'{pattern}'"


def strings(values) -> str:
    return f"array({', '.join(quoted(v) for v in values)})" if values else "cast(array() as array<string>)"
