from opslake.functions.semantics import *  # noqa: F401,F403
from opslake.functions.scalar import *  # noqa: F401,F403
