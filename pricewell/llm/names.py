"""Column names that do not clash with those of a table."""


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
