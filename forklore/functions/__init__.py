"""Column functions: text, dates and commit attributes."""

from forklore.functions.commits import *  # noqa: F401,F403
from forklore.functions.dates import *  # noqa: F401,F403
from forklore.functions.text import *  # noqa: F401,F403
