"""What can go wrong, by kind."""


class EngineError(Exception):
    """The base of all errors that a statement can raise."""


class ParseError(EngineError):
    """The text is no statement of the dialect."""


class TableAlreadyExists(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class InvalidSchema(EngineError):
    pass


class ColumnCountMismatch(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class InvalidData(EngineError):
    pass


class ColumnNotFound(EngineError):
    pass


class DuplicateKey(EngineError):
    pass


class NullConstraint(EngineError):
    pass


class ForeignKeyViolation(EngineError):
    pass


class IndexAlreadyExists(EngineError):
    pass


class IndexNotFound(EngineError):
    pass
