"""DataFrame-level steps, composable with ``df.transform``."""
