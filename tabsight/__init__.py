"""tabsight: understand, clean, model and query tables as Spark jobs."""

from tabsight.session import get_session

__all__ = ["get_session"]
