"""Column to Column functions; every one stays inside the JVM unless its module says so."""
