"""The archive jobs that make sense as new files arrive."""
