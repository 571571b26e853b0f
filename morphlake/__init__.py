"""Text analytics on Spark: tagging, lexicon scoring and tone classification as DataFrame operators."""

__version__ = "0.1.0"


def get_version() -> str:
    return __version__
