"""Portfolio analytics and data processing as Spark plans."""

from __future__ import annotations

import logging


def enable_logging(level: int = logging.INFO) -> logging.Logger:
    """The package's messages on the console, once however often it is called."""
    logger = logging.getLogger("meridia")
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
