import datetime as dt


def values(df, *columns):
    """Sorted tuples of some columns (default: all)."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def column(df, name):
    return sorted((r[0] for r in df.select(name).collect()), key=repr)


def day(text):
    return dt.date.fromisoformat(text)


def moment(text):
    return dt.datetime.fromisoformat(text)
