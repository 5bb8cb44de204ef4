"""Keeps composed expressions small: a large argument is computed once and bound to a lambda variable.

A function that reads an argument's entries twenty times would otherwise copy its whole expression
twenty times, and a few such functions in a row make trees that no optimizer can hold. Small
arguments, such as plain columns, are used directly and stay in generated code.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an expression's text from which on it is bound.
LIMIT = 500


def size_of(a) -> int:
    if isinstance(a, (list, tuple)):
        return sum(map(size_of, a))
    if not isinstance(a, Column):
        return 0
    if "size_" not in a.__dict__:
        a.__dict__["size_"] = len(a._jc.toString())
    return a.__dict__["size_"]


def binds(f: Callable) -> Callable:
    @functools.wraps(f)
    def wrapped(*args, **options):
        large = [i for i, a in enumerate(args) if isinstance(a, (Column, list, tuple)) and size_of(a) > LIMIT]
        if not large:
            return f(*args, **options)
        values = [args[i] if isinstance(args[i], Column) else F.array(*(a if isinstance(a, Column) else F.lit(float(a)) for a in args[i])) for i in large]
        widths = [0 if isinstance(args[i], Column) else len(args[i]) for i in large]
        several = 0

        def body(x: Column) -> Column:
            nonlocal several
            own = list(args)
            for n, (i, width) in enumerate(zip(large, widths, strict=True)):
                own[i] = [F.get(x[f"a{n}"], F.lit(k)) for k in range(width)] if width else x[f"a{n}"]
            found = f(*own, **options)
            if isinstance(found, tuple):
                several = len(found)
                return F.struct(*(v.alias(f"r{k}") for k, v in enumerate(found)))
            return found

        out = F.get(F.transform(F.array(F.struct(*(v.alias(f"a{n}") for n, v in enumerate(values)))), body), F.lit(0))
        return tuple(out[f"r{k}"] for k in range(several)) if several else out

    return wrapped


def bind_all(names: dict, module: str, leave: tuple[str, ...] = ()) -> None:
    """Wraps a module's own public functions."""
    for name, f in list(names.items()):
        if inspect.isfunction(f) and f.__module__ == module and not name.startswith("_") and name not in leave:
            names[name] = binds(f)
