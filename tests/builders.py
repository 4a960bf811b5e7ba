"""Small event arrays for tests."""

from keyloom.operators.replay import EVENT

SESSION = f"writer string, session_id long, target string, submitted string, events array<{EVENT}>"


def key(ch, press, release=None):
    return ("key", float(press), float(press + 50 if release is None else release), ch, None, None, None)


def bksp(press, release=None):
    return ("bksp", float(press), float(press + 50 if release is None else release), None, None, None, None)


def cursor(pos, press):
    return ("cursor", float(press), None, None, pos, None, None)


def seldel(a, b, press):
    return ("seldel", float(press), None, None, None, a, b)


def typist(text, gaps=None, gap=100, hold=50):
    """Types ``text``; gaps[i] comes before character i."""
    out, t = [], 0
    for i, c in enumerate(text):
        t += gaps[i] if gaps else (gap if i else 0)
        out.append(key(c, t, t + hold))
    return out


def sessions(spark, *lists, target="target"):
    return spark.createDataFrame([(f"w{i}", i, target, target, e) for i, e in enumerate(lists)], SESSION)


def long(df):
    from keyloom.operators.generated import long_events

    return long_events(df, ("writer", "session_id"))
