"""Training-data operators: thirteen corpus operators, each in a module of its own.

Nothing outside this package imports it; ``queries`` holds what is registered for the driver.
"""
