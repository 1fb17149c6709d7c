"""Launcher for spark-submit (which runs a file, not a module):

    spark-submit --py-files inocula.zip inocula_cli.py report --store ... --out ...
"""

import sys

from inocula.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
