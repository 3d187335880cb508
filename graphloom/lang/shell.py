"""A prompt for terms: prints each value and its type; a line that begins with q ends it."""

from __future__ import annotations

import cmd

from graphloom.lang.parser import TermSyntaxError, parse, standard_context
from graphloom.lang.terms import evaluate, show, typecheck
from graphloom.lang.types import TypeFailure, show_type


class Shell(cmd.Cmd):
    prompt = "? "

    def __init__(self, context=None, kb=None, **kw) -> None:
        super().__init__(**kw)
        self.context = context or (kb.context if kb else standard_context())
        self.kb = kb

    def default(self, line: str) -> bool:
        if line.startswith("q") or line == "EOF":
            return True
        try:
            term = parse(line, self.context)
            if term is not None:
                kind = typecheck(term)
                self.stdout.write(f"{show(evaluate(term))} : {show_type(kind)}\n")
                if self.kb is not None and kind == "t" and "exists" in line:
                    self.kb.query(term).show()
        except (TermSyntaxError, TypeFailure, ArithmeticError, ValueError) as e:
            self.stdout.write(f"{type(e).__name__}: {e}\n")
        return False


if __name__ == "__main__":
    Shell().cmdloop()
