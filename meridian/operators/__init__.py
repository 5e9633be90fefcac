"""Research operators over long panels (one row per ``di`` and ``code``)."""
