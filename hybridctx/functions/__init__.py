"""Column expressions."""
from hybridctx.functions.columns import *  # noqa: F401,F403
