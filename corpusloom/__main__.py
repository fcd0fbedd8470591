"""python -m corpusloom index | search | lisp | settings"""

from corpusloom.plans.console import main

main()
