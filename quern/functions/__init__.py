"""The dialect's functions as Column functions, for use without SQL text."""

from .columns import *  # noqa: F403
