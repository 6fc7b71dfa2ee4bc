"""Errors that a caller can act on."""


class OptionError(ValueError):
    """An option's text or a combination of options is wrong."""


class SchemaMismatch(ValueError):
    """Inputs that should be merged do not have the same schema."""


class OutputExists(FileExistsError):
    """An output path is taken and overwriting was not asked for."""


class PathCollision(ValueError):
    """Two partitions would be written to one path."""


class Unsupported(NotImplementedError):
    """A format or syntax that Spark cannot read, write or run."""
