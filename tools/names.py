"""Print the queries registered by the given plan modules."""
import sys
sys.path.insert(0, "/root/repo")
from barlens.plans import load
print(" ".join(n for n, f in load().QUERIES.items() if f.__module__.rsplit(".", 1)[1] in sys.argv[1:]))
