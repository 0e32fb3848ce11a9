"""Column expressions and small frame helpers; every one stays inside the JVM."""
