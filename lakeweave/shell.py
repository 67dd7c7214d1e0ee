"""An interactive shell: statements end with `;` or a line `/`; `.set name=value` and `.show [name]`."""

from __future__ import annotations

import cmd
import sys
from typing import IO

from lakeweave.session import Engine


class Shell(cmd.Cmd):
    prompt, more = "sql> ", "...> "
    intro = "End statements with ; or a line /. Settings: .set name=value, .show [name]. Leave with .quit"

    def __init__(self, engine: Engine, stdout: IO[str] | None = None, stdin: IO[str] | None = None):
        super().__init__(stdin=stdin, stdout=stdout or sys.stdout)
        self.use_rawinput = stdin is None
        self.engine, self.lines = engine, []

    def say(self, text: str) -> None:
        print(text, file=self.stdout)

    def emptyline(self) -> bool:
        return False

    def precmd(self, line: str) -> str:
        return "EOF" if line == "EOF" and not self.lines else "\0" + line

    def default(self, line: str) -> bool:
        line = line.removeprefix("\0")
        if line == "EOF":
            return True
        if not self.lines and line.strip().startswith("."):
            return self.command(line.strip())
        if line.strip() != "/":
            self.lines.append(line)
        if line.strip() == "/" or line.rstrip().endswith(";"):
            text, self.lines = "\n".join(self.lines), []
            if text.strip(" ;\n"):
                self.run(text)
        self.prompt = self.more if self.lines else type(self).prompt
        return False

    def command(self, line: str) -> bool:
        """A line that begins with a dot; true to leave."""
        word, _, rest = line.partition(" ")
        try:
            if word in (".quit", ".exit"):
                return True
            if word == ".set":
                name, eq, value = rest.partition("=")
                if not eq:
                    raise ValueError("use .set name=value")
                self.say(self.engine.settings.set(name.strip(), value.strip()))
            elif word == ".show":
                self.say(self.engine.settings.show(rest.strip() or None))
            else:
                raise ValueError(f"unknown command {word}")
        except ValueError as e:
            self.say(f"Error: {e}")
        return False

    def run(self, text: str) -> None:
        """Runs a statement and shows rows up to the limit, their number and size, and the time."""
        run = self.engine.sql(text)
        self.say(run.notice())
        if run.df is None:
            return
        most = self.engine.settings.max_rows
        try:
            # one row over the limit tells whether there are more, without fetching them
            table = run.arrow(most + 1 if most else 0)
        except Exception as e:  # what a query may raise has no common base; it is shown and the shell goes on
            self.say(f"Error: {e}")
            return
        shown = table.slice(0, most) if most else table
        self.say(shown.to_pandas().to_string(index=False))
        if shown.num_rows < table.num_rows:
            self.say(f"only the first {shown.num_rows} rows are shown")
        self.say(f"{shown.num_rows} rows, {shown.nbytes} bytes, {run.seconds:.3f} s")
