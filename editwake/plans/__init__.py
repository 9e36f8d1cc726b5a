"""How the work is laid out: size checks, ranks, leads, and whole searches."""
