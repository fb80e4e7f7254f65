"""What can be wrong with a log, a page or a catalogue."""


class LogError(Exception):
    """A log can't be read: `kind` is "io" or "corrupted"."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"log {kind}: {message}")
        self.kind = kind


class PageError(Exception):
    """A page's bytes aren't a page, or an entry can't go in one."""


class CatalogueError(Exception):
    """A catalogue can't be read: `kind` is "io", "serialization" or "corrupted"."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"catalogue {kind}: {message}")
        self.kind = kind
